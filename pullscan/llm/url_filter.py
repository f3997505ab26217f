"""URL filters by a Bloom filter cascade.

The first level holds the listed keys. The second holds those other keys of the corpus that pass the first, the third the
listed keys that pass the second, and so on until nothing passes wrongly. Over the complete key universe of the corpus the
answer is exact, and asking needs no join: the cascade is read by every task.

The universe is cut into segments by key hash, with a bounded number of keys each; one task builds all levels of a segment.

A key is a host suffix with the first characters of the path, in one of three spaces: block rules, allow rules, listed hosts.

Defined results: a null url, or one without ``://``, has an empty host and path and fits nothing. Repeated urls get equal
answers. An empty table gives an empty result. No column but ``page_id`` and ``url`` is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import mix, ship
from pullscan.session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CASCADE = "segment int, level int, bits long, hashes int, data binary"
#: Keys of a segment on average, and the bytes of levels that are sent to the tasks at once.
SEGMENT_KEYS, ROUND_BYTES = 1_000_000, 64 << 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, most: int) -> Column:
    """The host and the domains above it with at most ``most`` labels, shortest first; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    each = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when(host != "", each).otherwise(F.array().cast("array<string>"))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _spaced(keys: Column, space: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(space + "|"), k))


def _with_path(hosts: Column, length: int) -> Column:
    """Each host with the first characters of the path; none if the path is shorter."""
    each = F.transform(hosts, lambda s: F.concat(s, F.substring("path", 1, length)))
    return F.when(F.length("path") >= length, each).otherwise(F.array().cast("array<string>"))


def key_columns(keys: Column) -> tuple[Column, Column]:
    """Two independent hashes of each key; together 128 bits stand for the key."""
    return F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(k, F.lit(77)))


# -- the cascade -------------------------------------------------------------------------------------------------------


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    a, b = mix(h1 + np.uint64(level * 2 + 1)), mix(h2 + np.uint64(level * 2 + 2)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def _passes(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int, data: np.ndarray) -> np.ndarray:
    p = _places(h1, h2, level, bits, hashes)
    return ((data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def levels_of(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(level, bits, hashes, bytes) for one segment; nothing when it holds no listed key."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    level = 0
    while len(inside):
        # The first level lets as many other keys pass as there are listed ones, the later ones halve.
        rate = min(0.5, max(1e-6, len(inside) * math.sqrt(0.5) / max(1, len(outside)))) if level == 0 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(inside) * -math.log(rate) / math.log(2) ** 2))
        data = np.zeros(bits // 8 + 1, np.uint8)
        p = _places(h1[inside], h2[inside], level, bits, hashes).ravel()
        np.bitwise_or.at(data, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        yield level, bits, hashes, data
        inside, outside = outside[_passes(h1[outside], h2[outside], level, bits, hashes, data)], inside
        level += 1
        if level > 200:
            raise ValueError("two keys share both hashes")


def is_listed(h1: np.ndarray, h2: np.ndarray, levels: Sequence[tuple[int, int, int, np.ndarray]]) -> np.ndarray:
    """The number of levels a key passes before the first that refuses it is odd for a listed key, else even."""
    passed, at = np.zeros(len(h1), np.int64), np.arange(len(h1))
    for level, bits, hashes, data in levels:
        at = at[_passes(h1[at], h2[at], level, bits, hashes, data)]
        if not len(at):
            break
        passed[at] += 1
    return passed % 2 == 1


def build_cascade(universe: DataFrame, segments: int) -> DataFrame:
    """The levels of each segment, from ``h1, h2, listed`` (rows may repeat; a key listed once is listed)."""

    def build(t: pa.Table) -> pa.Table:
        h1, h2 = (t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        listed = t.column("listed").to_numpy(zero_copy_only=False).astype(bool)
        segment = t.column("segment")[0].as_py()
        rows = [(segment, level, bits, hashes, data.tobytes()) for level, bits, hashes, data in levels_of(h1, h2, listed)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        names = ["segment", "level", "bits", "hashes", "data"]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=names)

    keys = universe.groupBy("h1", "h2").agg(F.max("listed").alias("listed"))
    return keys.withColumn("segment", F.pmod("h1", F.lit(segments)).cast("int")).groupBy("segment").applyInArrow(build, CASCADE)


def _rounds(cascade: DataFrame, limit: int) -> Iterator[list]:
    """The levels in portions of at most ``limit`` bytes (a segment is never parted), each fetched by its own."""
    sizes = cascade.groupBy("segment").agg(F.sum(F.length("data")).alias("b")).orderBy("segment").collect()
    portion, total = [], 0
    for r in sizes:
        if portion and total + r.b > limit:
            yield cascade.where(F.col("segment").between(portion[0], portion[-1])).collect()
            portion, total = [], 0
        portion.append(r.segment)
        total += r.b
    if portion:
        yield cascade.where(F.col("segment").between(portion[0], portion[-1])).collect()


def probe(rows: DataFrame, cascade: DataFrame, segments: int, limit: int = ROUND_BYTES) -> DataFrame:
    """Adds ``member``, an array of booleans beside the arrays ``h1`` and ``h2``.

    A cascade larger than ``limit`` bytes is asked in rounds: one portion of segments at a time is sent to the tasks,
    and the table is written between rounds, so that no task ever holds more than one portion.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("member", F.transform("h1", lambda _: F.lit(False)))
    for i, portion in enumerate(_rounds(cascade, limit)):
        if i:
            path = shared_path(spark, "url-filter")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
        held: dict[int, list] = {}
        for r in sorted(portion, key=lambda r: r.level):
            held.setdefault(r.segment, []).append((r.level, r.bits, r.hashes, np.frombuffer(bytes(r.data), np.uint8)))
        sent = spark.sparkContext.broadcast(held)

        def ask(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.schema.names
                lists = b.column(names.index("h1"))
                h1 = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                h2 = b.column(names.index("h2")).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                was = b.column(names.index("member")).flatten().to_numpy(zero_copy_only=False).astype(bool).copy()
                segment = h1.view(np.int64) % segments
                for s in np.unique(segment):
                    if int(s) in sent.value:
                        at = np.flatnonzero(segment == s)
                        was[at] |= is_listed(h1[at], h2[at], sent.value[int(s)])
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
                new = pa.ListArray.from_arrays(pa.array(offsets), pa.array(was))
                yield pa.RecordBatch.from_arrays([new if n == "member" else b.column(n) for n in names], names)

        rows = rows.mapInArrow(ask, rows.schema)
    return rows


# -- the filter --------------------------------------------------------------------------------------------------------


def listed_hosts(pages: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Domains of the pages that start with one of the given labels, as a list of hosts to block."""
    host = pages.select(F.split(host_of(F.col("url")), r"\.").alias("labels")).where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    at = F.filter(F.sequence(F.lit(1), F.size("labels")), lambda i: F.get("labels", i - 1).isin(*labels))
    return host.select(F.explode(F.transform(at, lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("host")).distinct()


def filter_urls(pages: DataFrame, block: Sequence[str], allow: Sequence[str], listed: DataFrame, segment_keys: int = SEGMENT_KEYS, limit: int = ROUND_BYTES) -> DataFrame:
    """``page_id, url, host, path, rule, listed, verdict`` for each page.

    ``block`` and ``allow`` are rules such as ``example.net/en/``; ``listed`` has a column ``host``. A rule fits its host and
    all subdomains if the path starts with the rule's; the longest wins (then the longer host). Without a rule, a page is
    blocked if its host or a domain above it is listed.
    """
    ship(pages.sparkSession)
    rules = [("b", r, *split_rule(r)) for r in block] + [("a", r, *split_rule(r)) for r in allow]
    lengths = sorted({len(p) for _, _, _, p in rules})
    hosts = listed.select(F.translate(F.col("host"), UPPER, LOWER).alias("host")).where("host is not null and host != ''")
    most = hosts.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    most = max([most, *(h.count(".") + 1 for _, _, h, _ in rules)])
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    above = suffixes(F.col("host"), most)
    fits = F.flatten(F.array(*(_with_path(above, n) for n in lengths))) if rules else F.array().cast("array<string>")
    keys = F.concat(_spaced(fits, "a"), _spaced(fits, "b"), _spaced(above, "h"))
    rows = rows.withColumn("keys", keys)
    h1, h2 = key_columns(F.col("keys"))
    rows = rows.withColumns({"h1": h1, "h2": h2})

    names = pages.sparkSession.createDataFrame([(f"{s}|{h}{p}",) for s, _, h, p in rules] or [("",)], "key string")
    names = names.union(hosts.select(F.concat(F.lit("h|"), "host"))).select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(77)).alias("h2"), F.lit(True).alias("listed"))
    seen = rows.select(F.explode(F.arrays_zip("h1", "h2")).alias("k")).select("k.h1", "k.h2", F.lit(False).alias("listed"))
    at_most = pages.count() * most * (2 * len(lengths) + 1)
    segments = max(1, math.ceil(at_most / segment_keys))
    rows = probe(rows, build_cascade(seen.union(names), segments), segments, limit)

    hits = F.transform(F.filter(F.arrays_zip("keys", "member"), lambda x: x["member"]), lambda x: x["keys"])
    rows = rows.select("page_id", "url", "host", "path", hits.alias("hits"))
    # The rule of a key; a longer key first, then a longer host.
    order = sorted(rules, key=lambda r: (-len(r[2] + r[3]), -len(r[2]), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, text, h, p in reversed(order):
        hit = F.array_contains("hits", f"{s}|{h}{p}")
        rule = F.when(hit, F.lit(text)).otherwise(rule)
        verdict = F.when(hit, F.lit("block" if s == "b" else "allow")).otherwise(verdict)
    listed_host = F.exists("hits", lambda k: k.startswith("h|"))
    own = F.when(listed_host, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "url", "host", "path", rule.alias("rule"), listed_host.alias("listed"), F.coalesce(verdict, own).alias("verdict"))
