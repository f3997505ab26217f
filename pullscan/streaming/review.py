"""Continuous review of changed files: violations and log events, once for each delivered version.

Static analysis is row-local, so the batch function runs unchanged on a stream. A micro-batch writes three tables below one root,
each in a folder of its own batch number that is overwritten when the batch runs again: the keys of versions seen for the
first time, their violations, and their log events. What was seen before is read from the keys of earlier batches, so nothing but
keys is kept, and neither keys nor violations carry a text through a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pullscan.model import FILE_KEY, PR_KEY
from pullscan.operators import review as rv
from pullscan.plans.review import static_events
from pullscan.rules.config import RuleSet
from pullscan.sources.reviewlog import read_review_log

#: Where a row was delivered: what tells two deliveries of one version apart.
DELIVERY = ["source_file", "source_row"]
KEYS = "repo STRING, pr_number BIGINT, filename STRING, version STRING, arrived TIMESTAMP, source_file STRING, source_row BIGINT"


def read_file_stream(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """Parquet files as a stream with ``arrived``, the time their file was written, and ``source_file, source_row``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    m = "_metadata."
    return reader.parquet(path).withColumns(
        {"arrived": F.col(m + "file_modification_time"), "source_file": F.col(m + "file_path"), "source_row": F.col(m + "row_index")}
    )


def stream_review(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Violations of every row of a streaming table of changed files (``FILE_KEY``, ``content``, ``patch``), without any state."""
    return rv.analyze(files, rules, FILE_KEY)


def _folder(root: str, table: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{table}/batch_id={batch_id}"


def prepare(spark: SparkSession, root: str) -> None:
    """An empty table of keys, so that the first batch has something to read."""
    spark.createDataFrame([], KEYS).write.mode("ignore").parquet(_folder(root, "keys", -1))


def new_versions(files: DataFrame, batch_id: int, root: str, version: str, within: str) -> DataFrame:
    """The first delivery of each version that no earlier batch saw ``within`` that time; key columns only, written and read back."""
    spark = files.sparkSession
    keys = files.select(*PR_KEY, "filename", F.col(version).cast("string").alias("version"), "arrived", *DELIVERY)
    key = [*PR_KEY, "filename", "version"]
    delivery = F.struct("arrived", *DELIVERY)
    first = keys.groupBy(*key).agg(F.min(delivery).alias("d")).select(*key, "d.*")
    seen = spark.read.schema(KEYS + ", batch_id BIGINT").parquet(f"{root.rstrip('/')}/keys").where(F.col("batch_id") < batch_id)
    # One earliest time bounds what is read of the earlier keys; each key is then held against its own time.
    earliest = first.agg(F.min(F.unix_micros("arrived"))).first()[0]
    seen = seen.where(F.col("arrived") >= F.timestamp_micros(F.lit(earliest).cast("long")) - F.expr(f"INTERVAL {within}"))
    s, f = seen.alias("s"), first.alias("f")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key])
    fresh = f.join(s, same & (F.col("s.arrived") >= F.col("f.arrived") - F.expr(f"INTERVAL {within}")), "left_anti")
    path = _folder(root, "keys", batch_id)
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.schema(KEYS).parquet(path)


def review_batch(
    files: DataFrame, batch_id: int, rules: RuleSet, root: str, version: str | None = "head_sha", within: str = "1 hour"
) -> None:
    """One micro-batch: keys, violations, events. Run again with the same number it leaves the same tables."""
    spark = files.sparkSession
    if version:
        fresh = new_versions(files, batch_id, root, version, within)
        # A delivery is in ``fresh`` once, so an inner join keeps what a semi join would; that one would be moved below the
        # analysis, to the texts.
        found = rv.analyze(files, rules, [*FILE_KEY, *DELIVERY]).join(fresh.select(*DELIVERY), DELIVERY).drop(*DELIVERY)
    else:
        fresh = files.select(*PR_KEY, "filename", "arrived")
        found = rv.analyze(files, rules, FILE_KEY)
    path = _folder(root, "violations", batch_id)
    found.write.mode("overwrite").parquet(path)
    violations = spark.read.schema(found.schema).parquet(path)
    # The time of the newest file: the same whenever the batch runs again.
    at = F.timestamp_micros(F.lit(fresh.agg(F.max(F.unix_micros("arrived"))).first()[0]).cast("long"))
    headers = fresh.select(*PR_KEY).distinct()
    decisions = rv.pr_decisions(headers, fresh, violations, rules.delegation)
    events = static_events(headers, decisions, violations, rv.review_comments(violations), at)
    events.select("event_date", "value").write.mode("overwrite").partitionBy("event_date").text(_folder(root, "events", batch_id))


def start_review(
    files: DataFrame, rules: RuleSet, root: str, checkpoint: str, version: str | None = "head_sha",
    within: str = "1 hour", once: bool = False,
) -> StreamingQuery:
    """Review a stream into the tables below ``root``: each batch at least once, each of its folders with one batch's rows."""
    prepare(files.sparkSession, root)
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: review_batch(batch, batch_id, rules, root, version, within)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_violations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/violations")


def read_events(spark: SparkSession, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The log of all batches, of the days ``since`` to ``until`` alone where they are given."""
    return read_review_log(spark, f"{root.rstrip('/')}/events", since, until)
