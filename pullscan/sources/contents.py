"""File texts clustered by where they are looked up, so that a review moves only its own changed files.

The table of file contents is the largest by far and is read again with every review. Written once into buckets of
``(repo, path, ref)``, it joins changed files without being shuffled or sorted as a whole: only the changed files are dealt to its buckets.
The key is unique, so buckets are even, whatever repository holds most files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan import model

KEY = ("repo", "path", "ref")
#: Hidden from scans by its first letter; holds the number of buckets.
LAYOUT = "_buckets"


def write_contents(contents: DataFrame, path: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Write ``repo, path, ref, sha, content`` in buckets below ``path`` and return the table, opened from there.

    ``buckets`` fits the table, not the cluster: some hundred megabytes each. With ``mode="append"`` (the same number) a bucket gets a
    further file; joins still need no shuffle, only a sort inside the buckets.
    """
    spark = contents.sparkSession
    kept = _buckets(spark, path) if mode == "append" else None
    if kept is not None and kept != buckets:
        raise ValueError(f"the table has {kept} buckets, not {buckets}")
    name = _name()
    columns = [f.split()[0] for f in model.FILE_CONTENTS.split(", ")]
    # Dealt by the hash that buckets use, so each of them is one file of one task.
    dealt = contents.select(*columns).repartition(buckets, *KEY)
    if kept is not None:
        _define(spark, name, path, buckets)
        dealt.write.mode("append").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return spark.table(name)
    dealt.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)
    layout = spark.createDataFrame([(buckets,)], "buckets INT").coalesce(1)
    layout.write.mode("overwrite").json(f"{path.rstrip('/')}/{LAYOUT}")
    return spark.table(name)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_contents``, also one that another session wrote."""
    name = _name()
    _define(spark, name, path, _buckets(spark, path))
    return spark.table(name)


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets INT").json(f"{path.rstrip('/')}/{LAYOUT}").first().buckets


def _name() -> str:
    return f"file_contents_{uuid.uuid4().hex}"


def _define(spark: SparkSession, name: str, path: str, buckets: int) -> None:
    keys = ", ".join(KEY)
    spark.sql(
        f"CREATE TABLE {name} ({model.FILE_CONTENTS}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def wanted_contents(contents: DataFrame, keys: DataFrame) -> DataFrame:
    """The contents of some files; ``keys``: ``repo, path, ref``. On a bucketed table only the keys are moved."""
    return contents.join(keys.select(*KEY).distinct(), list(KEY), "left_semi").select(*[F.col(c) for c in contents.columns])
