"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by (hash of the text, hash of the record). A sample of these keys, drawn with a chance in proportion to a
record's size, gives splitters at its quantiles; the records are parted into the ranges between them. A range that turns out
overfull is parted again by further splitters of its own, until it fits. Sizes and counts of the ranges are then summed up in
order, so that each record's own place in the whole order is known from its range's base and a running sum within it: shard ``k`` takes
the bytes from ``k/n`` to ``(k+1)/n`` of all. The law is ``bytes``: sizes differ by one record at most at each end.

Equal texts are neighbours in the order, so they share a shard unless a border falls among them. A text that holds a third of
all rows is parted like any other, since the record's own hash parts it further.

Defined results: a null text has no bytes, so size 8 and checksum 0. A null or repeated ``doc_id`` stays, one row for each row, each with a
slot of its own. A very long text is a record like any other, and may alone be larger than a shard. Other columns, whatever their
names, take no part. An empty table gives no rows. Equal texts are parted where the border of a shard falls among them: the law is one of
sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullscan.llm.common import table_written

#: Records of a range on average, samples per range, and how many times the mean a range may hold.
RANGE_ROWS, SAMPLES_PER_RANGE, OVERFULL = 500_000, 16, 3


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and the order ``(h, s)``; ``s`` parts equal texts and is unique but for chance."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    return rows.select("doc_id", "size", "text_crc32", "h", F.xxhash64("doc_id", "p", "m").alias("s"))


def splitters(rows: DataFrame, total: int, ranges: int, seed: int) -> list[tuple[int, int]]:
    """Quantiles of a sample of keys; a record is drawn with a chance in proportion to its size.

    The sample is ``ranges * SAMPLES_PER_RANGE`` keys on average, and the quantiles are chosen where it lies; only
    ``ranges - 1`` keys come to the driver.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64("h", "s", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(chance * total < F.col("size") * wanted).select("h", "s")
    if ranges < 2:
        return []
    # Quantiles of each range of the hash's leading bits, summed up over the counts of all of them.
    cell = F.shiftright("h", 52)
    counts = drawn.groupBy(cell.alias("c")).count()
    base = counts.select("c", (F.sum("count").over(Window.orderBy("c")) - F.col("count")).alias("base"), F.sum("count").over(Window.partitionBy()).alias("all"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy("h", "s")) + F.col("base")
    ranked = drawn.withColumn("c", cell).join(F.broadcast(base), "c").withColumn("rank", rank)  # 4,096 cells at most
    slot = F.floor(F.col("rank") * ranges / F.col("all"))
    before = F.floor((F.col("rank") - 1) * ranges / F.col("all"))
    return [(r.h, r.s) for r in ranked.where((slot > before) & (slot < ranges)).select("h", "s").orderBy("h", "s").collect()]


def range_of(borders: list[tuple[int, int]]) -> Column:
    """The number of borders at or before (h, s), by binary search in a literal of the borders."""
    if not borders:
        return F.lit(0)
    # One text literal each, which constant folding turns into an array.
    hs, ss = (F.split(F.lit(",".join(str(b[i]) for b in borders)), ",").cast("array<long>") for i in (0, 1))
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(borders) + 1)) + 1))

    def step(x: Column, _: Column) -> Column:
        low, high = x["low"], x["high"]
        mid = F.shiftright(low + high, 1)
        at_h, at_s = F.get(hs, mid), F.get(ss, mid)
        before = (at_h < F.col("h")) | ((at_h == F.col("h")) & (at_s <= F.col("s")))
        return F.when(low >= high, x).when(before, F.struct((mid + 1).alias("low"), high.alias("high"))).otherwise(F.struct(low.alias("low"), mid.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))
    return F.aggregate(steps, start, step, lambda x: x["low"])


def shard_records(docs: DataFrame, shards: int = 24, range_rows: int = RANGE_ROWS, seed: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each document."""
    # The lean records are written once: their order must be the same for every later pass, also after a lost executor.
    rows = table_written(sized(docs), "sharding")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = max(4 * shards, math.ceil((n or 0) / range_rows)) if n else 1
    borders = splitters(rows, total or 1, ranges, seed)
    again = stuck = 0
    while True:
        held = rows.groupBy(range_of(borders).alias("r")).count().where(F.col("count") > OVERFULL * max(64, n / ranges)).collect() if n else []
        if not held:
            break
        full = {r.r: r["count"] for r in held}
        inside = rows.withColumn("r", range_of(borders)).where(F.col("r").isin(*full)).drop("r")
        share = max(2, math.ceil(2 * sum(full.values()) * ranges / n))
        more = splitters(inside, inside.agg(F.sum("size")).first()[0], share, seed + 1 + again)
        # Each round draws another sample; where none of several parts a range, its records share one key.
        stuck = stuck + 1 if set(more) <= set(borders) else 0
        if stuck == 5:
            raise ValueError(f"{len(full)} ranges hold records that no key parts")
        borders, again = sorted({*borders, *more}), again + 1

    placed = rows.withColumn("r", range_of(borders))
    sums = placed.groupBy("r").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("r")
    base = sums.select("r", (F.sum("b").over(before) - F.col("b")).alias("b0"))  # as many rows as there are ranges
    inner = Window.partitionBy("r").orderBy("h", "s", "doc_id", "size")
    begin = F.col("b0") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = placed.join(F.broadcast(base), "r").withColumns({"begin": begin, "k": F.row_number().over(inner)})
    # The middle of a record decides, in whole numbers.
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * begin + size) * {shards} div {2 * max(1, total or 1)}")).cast("int"))
    # Slots: how many records of the shard lie in earlier ranges, and the place among those of its own range.
    parts = placed.groupBy("shard", "r").agg(F.count("*").alias("n"), F.min("k").alias("k0"))
    slots = parts.select(F.col("shard").alias("s_"), F.col("r").alias("r_"), "k0", (F.sum("n").over(Window.partitionBy("shard").orderBy("r")) - F.col("n")).alias("slot0"))
    joined = placed.join(F.broadcast(slots), (F.col("shard") == F.col("s_")) & (F.col("r") == F.col("r_")))  # ranges and shards in number
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("k") - F.col("k0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
