"""Approximate nearest neighbours by cosine with a hash-prefix forest.

The index is dealt to shards of bounded size. Each shard has ``trees`` trees: sorted arrays of long bit strings (signs of random
projections, around the mean of a bounded sample), held as codes and places; a vector is there once. Every query visits every
shard. It descends to its longest-prefix matches in each array, and all trees are then ascended at once: the
prefix is shortened, by the same bit in every tree, until the matches of all trees together are the shard's part of ``wanted``. These are scored,
each row once, and the best ``k`` leave the shard.

A shard is a sample of all rows, so no match lies behind a border, and rows of one code, or one direction, are spread over all shards. Inside a
shard equal vectors are scored once, with their ``k + 1`` smallest ids, of which no query can want another.

Candidates near the last place are scored again by one formula on the original vectors in double precision, with one order of
addition, which alone decides: ``sum(a * b) / sqrt(sum(a * a) * sum(b * b))``. Components are first scaled by a power of two, which
changes no digit of the result, where squares would overflow or vanish.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part. Vectors of another length are only
compared with their like. A query with no other vector has no rows; rows without an id take no part. Repeated rows are one
entry; other vectors of a repeated id are compared too, and the id has the best of their scores. Other columns, whatever their names, take no
part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pullscan.llm.common import dealt, shards_of, ship, table_written

TREES, BITS = 64, 62
SHARD_ROWS, SHARD_BYTES = 1 << 17, 64 << 20
#: Matches asked for in all trees together, as a part of all rows: ``REACH / n ** (1/3)`` of them. Signs of projections of weakly alike
#: vectors need a part that shrinks no faster.
REACH = 15.0
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)


def packed(rows: DataFrame) -> DataFrame:
    """``id, r, x``: the vectors as bytes behind a tag, ``f`` for components that single precision holds exactly, else ``d``, with the
    row's number in its task."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            lists = b.column("v")
            flat, n = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy()
            with np.errstate(over="ignore"):
                small = flat.astype(np.float32)
            same = np.concatenate([[0], np.cumsum(small.astype(np.float64) != flat)])
            ends = np.cumsum(n)
            x = [b"d" + flat[e - k : e].tobytes() if same[e] > same[e - k] else b"f" + small[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            r = pa.array(np.arange(seen, seen + len(x)))
            seen += len(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), r, pa.array(x, pa.binary())], ["id", "r", "x"])

    return rows.mapInArrow(each, "id long, r long, x binary")


def by_length(values: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Packed vectors by their number of components: that number, their places in order, and the matrix."""
    single = np.array([v[:1] == b"f" for v in values], bool)
    size = np.array([len(v) - 1 for v in values], np.int64) // np.where(single, 4, 8)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.empty((len(at), n))
        for kind, mask in (("<f4", single[at]), ("<f8", ~single[at])):
            x[mask] = np.frombuffer(b"".join(values[i][1:] for i in at[mask]), kind).reshape(-1, n)
        yield int(n), at, x


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by a power of two, so that the largest component is near 1; their cosines keep every digit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The scores of rows against one vector; each depends on its own two vectors alone."""
    return (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum())


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS))


def codes(unit: np.ndarray, center: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, vectors) bit strings, the first bit highest."""
    out, p = np.empty((trees, len(unit)), np.int64), planes(unit.shape[1], trees, seed).reshape(unit.shape[1], trees, BITS)
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for t in range(trees):
        out[t] = ((unit - center) @ p[:, t] > 0).astype(np.int64) @ weight
    return out


class Forest:
    """The trees of one shard, for vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, center: np.ndarray, trees: int, seed: int, k: int) -> None:
        # Rows are sorted by id: of equal vectors the first k + 1 different ids stay, under the first one's place.
        x = scaled(x)
        _, first, group = np.unique(x.view(np.dtype((np.void, x.strides[0]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        new = np.append(True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
        order = order[new]
        begins = np.searchsorted(group[order], np.arange(len(first)))
        rank = np.arange(len(order)) - begins[group[order]]
        self.member_of, self.members = group[order][rank <= k], ids[order][rank <= k]
        self.begin = np.searchsorted(self.member_of, np.arange(len(first) + 1))
        self.x = x[first]
        self.unit = self.x / np.sqrt((self.x * self.x).sum(axis=1, keepdims=True))
        self.center, self.trees, self.seed, self.k = center, trees, seed, k
        codes_ = codes(self.unit, center, trees, seed)
        self.place = np.argsort(codes_, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes_, self.place.astype(np.int64), axis=1)

    def ranges(self, wanted: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) first and last place of the rows that share ``depth`` bits with each query's codes."""
        free = BITS - depth
        low = wanted >> free << free
        high = low + (np.int64(1) << free) - 1
        first = np.stack([np.searchsorted(s, a, "left") for s, a in zip(self.sorted, low, strict=True)])
        return first, np.stack([np.searchsorted(s, b, "right") for s, b in zip(self.sorted, high, strict=True)])

    def ascend(self, wanted: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges at the longest prefix, of one length in all trees, that has so many matches together. Matches only grow as the
        prefix is shortened, so its length is found by halving."""
        n = wanted.shape[1]
        low, high = np.zeros(n, np.int64), np.full(n, BITS, np.int64)
        while (low < high).any():
            half = (low + high + 1) >> 1
            a, b = self.ranges(wanted, half)
            enough = (b - a).sum(axis=0) >= matches
            low, high = np.where(enough, half, low), np.where(enough, high, half - 1)
        return self.ranges(wanted, low)

    def nearest(self, ids: np.ndarray, q: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query its id, repeated, the ids found and their scores: the best ``k`` of the candidates, ties by smaller id."""
        q = scaled(q)
        unit = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        matches = max(4 * (self.k + 1), int(share * len(self.x) * self.trees / TREES))
        first, last = self.ascend(codes(unit, self.center, self.trees, self.seed), matches)
        seen = np.zeros(len(self.x), bool)
        for j in range(len(q)):
            seen[:] = False
            for t in range(self.trees):
                seen[self.place[t, first[t, j] : last[t, j]]] = True
            at = np.flatnonzero(seen)
            near = self.unit[at] @ unit[j]
            # The query's own row may be among them, so one more than k counts for the border; rounding is far below the margin.
            if len(at) > self.k + 1:
                kept = near >= np.partition(near, len(near) - self.k - 1)[len(near) - self.k - 1] - 1e-9
                at = at[kept]
            score = cosines(self.x[at], q[j])
            counts = self.begin[at + 1] - self.begin[at]
            member = np.repeat(self.begin[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            found, score = self.members[member], np.repeat(score, counts)
            other = found != ids[j]
            found, score = found[other], score[other]
            order = np.lexsort((found, -score))
            found, score = found[order], score[order]
            once = np.sort(np.unique(found, return_index=True)[1])[: self.k]
            yield np.full(len(once), ids[j]), found[once], score[once]


def nearest(vectors: DataFrame, query_every: int = 50, k: int = 5, vector: str = "embedding", trees: int = TREES, seed: int = 4, sample_rows: int = 20_000, shard_rows: int = SHARD_ROWS, reach: float = REACH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``query_every``.

    ``sample_rows`` bounds the sample of which the mean is taken; every row is indexed.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = table_written(packed(usable(vectors, vector)), "forest")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("x") + 64), F.lit(0)).alias("bytes")).first()
    part = min(1.0, sample_rows / max(size.n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("id", "r", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))).select("x").limit(2 * sample_rows).collect()
    centers = {}
    for dim, _, x in by_length([bytes(r.x) for r in chosen]) if chosen else ():
        x = scaled(x)
        centers[dim] = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).mean(axis=0)
    # Shards of bounded rows and bytes, and enough of them for all cores.
    shards = max(-(-size.n // shard_rows), -(-size.bytes // SHARD_BYTES), 4 * spark.sparkContext.defaultParallelism)
    share = reach / max(size.n, 1) ** (1 / 3)
    asked = rows.where(F.pmod("id", F.lit(query_every)) == 0).select("id", "x").distinct()

    def index(t: pa.Table) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        ids = t.column("id").to_numpy()
        forests = {n: Forest(ids[at], x, centers.get(n, np.zeros(n)), trees, seed, k) for n, at, x in by_length(t.column("x").to_pylist())}

        def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            own = b.column("id").to_numpy()
            for n, at, q in by_length(b.column("x").to_pylist()):
                for begin in range(0, len(at) if n in forests else 0, 256):
                    c = slice(begin, begin + 256)
                    found = list(forests[n].nearest(own[at[c]], q[c], share))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

        return answer

    found = dealt(rows, asked, shards).mapInArrow(lambda batches: shards_of(batches, index), FOUND)
    # Repeated ids, and ids asked with several vectors, count with their best score.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
