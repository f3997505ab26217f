"""What several of the operators share: reading tables, words of texts as hashes, and the labelled sample."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan.session import shared_path

_shipped: set[str] = set()


def package_zip() -> bytes:
    """The modules of this package as an archive Python can import from; the same bytes whenever it is made."""
    import pullscan

    root = os.path.dirname(os.path.abspath(pullscan.__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    z.writestr(zipfile.ZipInfo(os.path.join("pullscan", os.path.relpath(path, root))), f.read())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Python workers import these modules by name, so each context gets the package once, as a file that Spark itself sends to
    every executor, also to one that joins later."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    # Below the folder where the driver keeps what it serves to executors.
    path = os.path.join(SparkFiles.getRootDirectory(), "pullscan-modules.zip")
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(package_zip())
        context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text`` (null: empty); every other column, whatever its name, stays out of the work."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def table_written(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the session's shared folder and read again: lineage ends, and every later pass sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8, a null as an empty one."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column in runs of about ``most`` bytes (one text at least) with the row each run begins at, so that the
    memory of a task does not grow with the batch."""
    begin = held = 0
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, byte_texts(column.slice(begin, i - begin))
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, byte_texts(column.slice(begin))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits, one to one."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, by its first word; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed * 1000 + 17)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += words[k : k + n] * factors[k]
    return mix(out)


def batches_of_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a sorted partition, one table each; only the run at hand is kept."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        columns = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(t.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(new).tolist(), t.num_rows]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i and held:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(t.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held)


def dealt(rows: DataFrame, asked: DataFrame, shards: int, number: str = "r") -> DataFrame:
    """Every row in one of ``shards`` partitions, by a hash of ``id`` and ``number`` (which tells repeated rows apart), and a copy of
    everything ``asked`` in each of them: first the rows of the shard by id, then what is asked, marked ``is_asked``.

    What is asked is a stated query set; a shard's own rows are bounded by the number of shards, however often a row is repeated.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema.fields if f.name not in rows.columns]
    left = rows.select(F.pmod(F.xxhash64("id", number), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_asked"), *[c for c in rows.columns if c != number], *none)
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_asked"), *asked.columns)
    return left.unionByName(right).repartitionById(shards, "shard").sortWithinPartitions("shard", "is_asked", "id")


def shards_of(batches: Iterator[pa.RecordBatch], index: Callable[[pa.Table], Callable]) -> Iterator[pa.RecordBatch]:
    """Answers over partitions of ``dealt``: ``index`` is made once of a shard's rows and gives the function that what is asked of
    the shard streams through, one batch at a time."""
    held: list[pa.RecordBatch] = []
    answer, shard = None, None
    for b in batches:
        of, asked = b.column("shard").to_numpy(), b.column("is_asked").to_numpy(zero_copy_only=False).astype(bool)
        change = np.append(True, (of[1:] != of[:-1]) | (asked[1:] != asked[:-1])) if len(of) else np.zeros(0, bool)
        cuts = [*np.flatnonzero(change).tolist(), len(of)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if of[s] != shard:
                held, answer, shard = [], None, of[s]
            if not asked[s]:
                held.append(b.slice(s, e - s))
                continue
            if answer is None:
                answer, held = index(pa.Table.from_batches(held, b.schema)), []
            yield from answer(b.slice(s, e - s))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, salt: int = 0) -> list[tuple[bytes, int, int]]:
    """(text, quality, toxic) of at most ``per_class`` labelled documents of each of the four classes, twice that of the good ones.

    The bound is a documented parameter of the classifiers. The rows are those with the smallest hashes of their id, so
    the sample is the same at every run; rows with a null id or label are no samples. Its ids (bounded) are broadcast. Of
    copies and near copies among the sampled texts one stays, else a word they share would seem to be frequent.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    y = y.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id", F.lit(salt)))
    picked = None
    for q in (0, 1):
        for t in (0, 1):
            part = y.where((F.col("q") == q) & (F.col("t") == t)).orderBy("h", "doc_id").limit(per_class * (2 if (q, t) == (1, 0) else 1))
            picked = part if picked is None else picked.unionByName(part)
    chosen = {r.doc_id: (r.q, r.t) for r in picked.collect()}
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    # A text held by several rows of one id counts once.
    found = id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").cast("binary").alias("text")).collect()
    out, seen = [], set()
    for r in sorted(found, key=lambda r: r.doc_id):
        text = bytes(r.text)
        h = window_hashes(word_hashes(text.split()), 5)
        least = {(k, int(mix(h + np.uint64(k)).min())) for k in range(5)} if len(h) else {text}
        if not least & seen:
            out.append((text, *chosen[r.doc_id]))
        seen |= least
    return out
