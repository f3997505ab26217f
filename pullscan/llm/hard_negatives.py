"""Hard negatives by slot-decomposed selection.

The anchors are a stated query set, scored against all rows in blocks. Rows are dealt to shards of bounded size; each shard gets a copy of
every anchor, holds its rows as one integer matrix and streams the anchors past it, some hundred at a time.

The upper limits of an anchor's positives split the scores into disjoint slots: slot ``j`` holds the scores above the limit of positive
``j + 1`` up to that of positive ``j``. The windows of the positives overlap, but each is a run of slots, cut off below. A shard keeps the best
``k`` rows of each slot, whatever the number of windows; the shards' lists are merged by slot, again ``k`` each. One descending
suffix merge, from the last slot to the first, then has the best ``k`` rows at or below each upper limit, and the lower limit
drops those outside the window. The positives come from the same selection, with one slot for rows of the same label.

Scores are integers. They are exact in double-precision products as long as no sum can reach 2**53; blocks with larger
components are multiplied as Python integers, and a score beyond 64 bits counts as the nearest 64-bit number.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part, nor do vectors of another
length than the anchor's, for that anchor. Repeated rows are each a candidate; the anchor's own id is none. Repeated equal
anchors are one anchor, different rows of one id one anchor each. Positives with equal scores have equal windows and an
empty slot between them. An anchor without other rows of its label has no rows, nor has a window without rows in it. Other columns, whatever
their names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullscan.llm.common import dealt, shards_of, ship, table_written

SHARD_ROWS, SHARD_BYTES = 1 << 18, 64 << 20
CHUNK, ANCHORS = 8192, 128
#: Scores lie above the one and up to the other.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "a long, slot int, score long, id long"


def usable(vectors: DataFrame, relabel_every: int, labels: int, vector: str, scale: int) -> DataFrame:
    """``id, label, x``: the rows that take part, components scaled and rounded down."""
    v = F.col(vector).cast("array<double>")
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), v.alias("x")).where("id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    moved = F.when(F.pmod("id", F.lit(relabel_every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # The product is taken in double precision; a component that overflows there is held as the largest double.
    scaled = F.transform("x", lambda c: F.least(F.greatest(c * float(scale), F.lit(-1.7976931348623157e308)), F.lit(1.7976931348623157e308)))
    return rows.select("id", moved.alias("label"), scaled.alias("x"))


def packed(rows: DataFrame) -> DataFrame:
    """The same rows with the components rounded down and packed, and the row's number ``r`` in its task.

    A vector is a tag and its components: ``h`` with 16-bit numbers, else ``d`` with doubles, which hold larger whole numbers as they are.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            lists = b.column("x")
            flat, n = np.floor(lists.flatten().to_numpy(zero_copy_only=False)), lists.value_lengths().to_numpy()
            parts = [flat[e - k : e] for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
            x = [b"h" + p.astype("<i2").tobytes() if np.abs(p).max(initial=0) < 1 << 15 else b"d" + p.tobytes() for p in parts]
            r = pa.array(np.arange(seen, seen + len(x)))
            seen += len(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), r, pa.array(x, pa.binary())], ["id", "label", "r", "x"])

    return rows.mapInArrow(each, "id long, label long, r long, x binary")


def by_length(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Packed vectors by their number of components: that number, the rows in order, and the matrix."""
    values = column.to_pylist()
    tag = np.array([v[:1] == b"h" for v in values], bool)
    size = np.array([len(v) - 1 for v in values], np.int64) // np.where(tag, 2, 8)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.empty((len(at), n))
        for kind, mask in (("<i2", tag[at]), ("<f8", ~tag[at])):
            x[mask] = np.frombuffer(b"".join(values[i][1:] for i in at[mask]), kind).reshape(-1, n) if n else 0
        yield int(n), at, x


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of two integer-valued matrices, held within 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).dot(whole(x).T) if a.shape[1] else np.zeros((len(a), len(x)), object)
    return np.array([[min(max(s, LEAST + 1), MOST) for s in row] for row in exact], np.int64).reshape(len(a), len(x))


class Best:
    """The best ``k`` of each (anchor, slot): highest scores first, ties by smaller place. Fed in chunks of growing place."""

    def __init__(self, tops: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.k, self.tops = k, tops
        n, slots = tops.shape
        #: A score must exceed this to enter: what ends the slot below, or the k-th best so far.
        self.bar = np.maximum(np.concatenate([tops[:, 1:], np.full((n, 1), LEAST)], axis=1), floor[:, None])
        self.score = np.full((n, slots, k), LEAST, np.int64)
        self.place = np.full((n, slots, k), -1, np.int64)

    def feed(self, scores: np.ndarray, allowed: np.ndarray, first: int) -> None:
        for j in range(self.tops.shape[1]):
            # A tie with the k-th best loses, since places grow.
            hit = allowed & (scores <= self.tops[:, j, None]) & (scores > self.bar[:, j, None])
            row, col = np.nonzero(hit)
            if not len(row):
                continue
            s, p = scores[row, col], col + first
            held_row, held_at = np.nonzero(self.place[:, j] >= 0)
            row, s, p = (np.concatenate([x, y]) for x, y in ((held_row, row), (self.score[held_row, j, held_at], s), (self.place[held_row, j, held_at], p)))
            order = np.lexsort((p, ~s, row))
            row, s, p = row[order], s[order], p[order]
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
            kept = rank < self.k
            row, s, p, rank = row[kept], s[kept], p[kept], rank[kept]
            self.score[row, j, rank], self.place[row, j, rank] = s, p
            full = row[rank == self.k - 1]
            self.bar[full, j] = self.score[full, j, -1]


def _floor_of(tops: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The bar below the last slot: scores under the least lower limit are in no window."""
    return np.where(floor > LEAST, floor - 1, LEAST)


def index_of(rows: pa.Table, k: int, same_label: bool) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A shard's rows as matrices, and the function from anchors to ``FOUND`` among them."""
    ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
    # Rows are sorted by id, so places in these groups are too.
    groups = {n: (ids[at], labels[at], x) for n, at, x in by_length(rows.column("x"))}

    def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for n, at_all, vectors in by_length(b.column("x")):
            if n not in groups:
                continue
            row_id, row_label, x = groups[n]
            for begin in range(0, len(at_all), ANCHORS):
                c, a = at_all[begin : begin + ANCHORS], vectors[begin : begin + ANCHORS]
                part = b.take(pa.array(c))
                own, label = part.column("id").to_numpy(), part.column("label").to_numpy()
                if same_label:
                    tops, floor = np.full((len(c), 1), MOST), np.full(len(c), LEAST)
                else:
                    tops = np.array(part.column("tops").to_pylist(), np.int64).reshape(len(c), -1)
                    floor = part.column("floor").to_numpy()
                best, at, step = Best(tops, _floor_of(tops, floor), k), 0, 256
                while at < len(x):  # short chunks first raise the bars
                    chunk = slice(at, at + step)
                    allowed = (row_label[chunk] == label[:, None]) == same_label
                    if same_label:
                        allowed &= row_id[chunk] != own[:, None]
                    best.feed(products(a, x[chunk]), allowed, at)
                    at, step = at + step, min(step * 4, CHUNK)
                i, slot, rank = np.nonzero(best.place >= 0)
                key = part.column("a").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(slot.astype(np.int32)), pa.array(best.score[i, slot, rank]), pa.array(row_id[best.place[i, slot, rank]])], ["a", "slot", "score", "id"])

    return answer


def selected(rows: DataFrame, anchors: DataFrame, shards: int, k: int, same_label: bool) -> DataFrame:
    """``FOUND``: the best ``k`` rows of each slot of each anchor over all shards."""
    found = dealt(rows, anchors, shards).mapInArrow(lambda batches: shards_of(batches, lambda t: index_of(t, k, same_label)), FOUND)
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def limit(score: Column, share: int, up: bool) -> Column:
    """``share`` hundredths of a score, rounded up or down to a whole number; exact, in decimals."""
    whole = score.cast("decimal(20,0)") * F.lit(Decimal(share))
    part = (whole / F.lit(Decimal(100))).cast("decimal(38,4)")
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def mine(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, relabel_every: int = 7, labels: int = 10, vector: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's, whole numbers. ``high`` is no less than 0:
    the upper limits then fall with the positives.
    """
    if high < 0:
        raise ValueError("the upper limit would rise where the positives fall")
    spark = vectors.sparkSession
    ship(spark)
    rows = table_written(packed(usable(vectors, relabel_every, labels, vector, scale)), "negatives-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("x") + 32), F.lit(0)).alias("bytes")).first()
    # Shards of bounded rows and bytes, and enough of them for all cores.
    shards = max(-(-size.n // shard_rows), -(-size.bytes // SHARD_BYTES), 4 * spark.sparkContext.defaultParallelism)
    asked = rows.where(F.pmod("id", F.lit(anchor_every)) == 0).select("id", "label", "x").distinct()
    anchors = table_written(asked.withColumn("a", F.monotonically_increasing_id()), "negatives-anchors")
    none = anchors.withColumns({"tops": F.lit(None).cast("array<long>"), "floor": F.lit(None).cast("long")})
    first = selected(rows, none, shards, positives, True)
    # At most ``positives`` entries of an anchor are gathered.
    best = first.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "id", "score"))).alias("p"))
    upper = F.transform("p", lambda x: limit(x["score"], high, False))
    # An anchor with fewer positives has its last limit repeated: the slots between are empty.
    filled = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.element_at("tops", F.least(i, F.size("tops"))))
    lowest = F.array_min(F.transform("p", lambda x: limit(x["score"], low, True)))
    known = best.select("a", "p", upper.alias("tops"), lowest.alias("floor")).withColumn("tops", filled)
    windows = table_written(anchors.join(known, "a"), "negatives-windows")
    second = selected(rows, windows.select("a", "id", "label", "x", "tops", "floor"), shards, k, False)
    entry = F.struct("slot", (-F.col("score").cast("decimal(20,0)")).alias("down"), "id", "score")
    lists = second.groupBy("a").agg(F.sort_array(F.collect_list(entry)).alias("found"))  # k of each slot at most
    # The suffix of slots i, i + 1, ... in order begins with the best rows at or below limit i.
    each = windows.select("a", F.col("id").alias("anchor_id"), F.posexplode("p").alias("i", "pos")).join(lists, "a")
    suffix = F.slice(F.filter("found", lambda e: e["slot"] >= F.col("i")), 1, k)
    inside = F.filter(suffix, lambda e: (e["score"] >= limit(F.col("pos.score"), low, True)) & (e["score"] <= limit(F.col("pos.score"), high, False)))
    return each.select("anchor_id", "pos", F.posexplode(inside).alias("r", "e")).select(
        "anchor_id", F.col("pos.id").alias("positive_id"), (F.col("r") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"),
        F.col("pos.score").alias("positive_score"), F.col("e.score").alias("negative_score"),
    )
