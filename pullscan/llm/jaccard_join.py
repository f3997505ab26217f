"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word 5-grams (words: runs of letters and digits, lower-cased). Of each different text 160 MinHash values of 16 bits are
kept. Texts that agree on one of 40 bands of four values are candidates: a pair of similarity 0.8 shares none with a probability
of 7e-10. A pair is looked at in the first band it shares only. Its MinHash values are compared in steps; after each, the pair is
dropped when the posterior probability that its similarity reaches the threshold (uniform prior) is below ``tolerance``. The
rest is verified exactly on the 5-grams themselves.

Texts of the same words are one text throughout, and links among their documents are counted, not expanded. A band value that many texts share is parted into blocks, and each pair of blocks is a piece of work
of its own, of bounded size; what leaves it is one row per text (its number of links, and a root), never pairs. Texts go to
the verifying tasks only if a candidate of theirs outlived the pruning.

Defined results: a text of fewer than five words is one n-gram of all its words; text without letters and digits uses what stands between white
space; a null or empty text has no n-grams, no links, and is a class of its own row's copies. A null ``doc_id`` stays null. Repeated rows are
copies of each other. Texts of any length count with all their n-grams. Other columns, whatever their names, take no part. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import mix, ship, slices, table_written, window_hashes, word_hashes

WORD = re.compile(r"\w+")
HASHES, ROWS, STEP = 160, 4, 32
BANDS = HASHES // ROWS
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
ADDENDS = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))
#: Texts of a block, and bits of the filter that keeps other texts from being shuffled.
BLOCK, FILTER_BITS = 256, 1 << 26
#: Bytes of words whose n-grams a verifying task holds at a time, unless one group has more.
PIECE = 1 << 21


def normal_words(text: bytes) -> list[bytes]:
    words = WORD.findall(text.decode().lower())
    return [w.encode() for w in words] if words else text.split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The different n-grams as sorted hashes."""
    return np.unique(window_hashes(word_hashes(words), min(size, len(words)))) if words else np.zeros(0, np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), 2048):
            least = np.minimum(least, (grams[None, a : a + 2048] * FACTORS[:, None] + ADDENDS[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number n of compared values, how many must agree for P(similarity >= threshold | agreeing of n) >= tolerance.

    With a uniform prior the posterior is a beta distribution, and its tail above the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(HASHES + 1):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _pairs_of(sizes: np.ndarray, begins: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs to look at in each group: all, or those across the two blocks."""
    two = begins[sizes == 2]
    left, right = [two], [two + 1]
    for a, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        s = side[a : a + n]
        if s.any():
            i, j = np.meshgrid(np.flatnonzero(~s), np.flatnonzero(s), indexing="ij")
            i, j = i.ravel(), j.ravel()
        else:
            i, j = np.triu_indices(n, 1)
        left.append(a + i)
        right.append(a + j)
    return np.concatenate(left), np.concatenate(right)


def surviving(sketches: np.ndarray, band: np.ndarray, left: np.ndarray, right: np.ndarray, need: list[int]) -> np.ndarray:
    """Which pairs are at home in this band and outlive the pruning."""
    out = np.zeros(len(left), bool)
    keys = sketches.view(np.uint64)
    for a in range(0, len(left), 65536):
        i, j = left[a : a + 65536], right[a : a + 65536]
        alive = np.flatnonzero((keys[i] == keys[j]).argmax(axis=1) == band[i])
        matches = np.zeros(len(alive), np.int64)
        for n in range(0, HASHES, STEP):
            matches += (sketches[i[alive], n : n + STEP] == sketches[j[alive], n : n + STEP]).sum(axis=1)
            stay = matches >= need[n + STEP]
            alive, matches = alive[stay], matches[stay]
        out[a + alive] = True
    return out


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (band value, block, block) from sorted rows; a group is never parted."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        cut = _changes(t)[-1]
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _changes(t: pa.Table) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("key", "bi", "bj"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _pieces(t: pa.Table, column: str, most: int = PIECE) -> Iterator[pa.Table]:
    """Runs of whole groups with about ``most`` bytes in a column (one group at least): a batch of long texts is not held as n-grams at once."""
    ends = np.cumsum(pc.binary_length(t.column(column)).to_numpy().astype(np.int64))
    begins = _changes(t).tolist()
    at = 0
    for a, b in zip(begins, [*begins[1:], t.num_rows], strict=True):
        if a > at and ends[b - 1] - (ends[at - 1] if at else 0) > most:
            yield t.slice(at, a - at)
            at = a
    yield t.slice(at)


def _survivors(t: pa.Table, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    begins = _changes(t)
    sizes = np.diff(np.append(begins, t.num_rows))
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, HASHES)
    own, bi, bj = (t.column(c).to_numpy() for c in ("own", "bi", "bj"))
    left, right = _pairs_of(sizes, begins, (bi != bj) & (own == bj))
    ok = surviving(sketches, t.column("band").to_numpy(), left, right, need)
    return left[ok], right[ok]


def verified(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have an exact similarity of the threshold or more."""
    out = np.zeros(len(left), bool)
    if not len(left):
        return out
    used = np.unique(np.concatenate([left, right]))
    values, at = np.unique(np.concatenate([grams[i] for i in used]), return_inverse=True)
    ends = np.cumsum([len(grams[i]) for i in used])
    numbers = {int(i): at[e - len(grams[i]) : e] for i, e in zip(used, ends, strict=True)}
    marks = np.zeros(len(values), bool)
    order = np.argsort(left, kind="stable")
    cuts = np.flatnonzero(np.diff(left[order], prepend=-1)).tolist() + [len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        i = int(left[rows[0]])
        marks[numbers[i]] = True
        for r in rows.tolist():
            other = numbers[int(right[r])]
            shared = int(np.count_nonzero(marks[other]))
            # In whole numbers, so that a similarity of exactly the threshold counts.
            out[r] = shared * 10**6 >= round(threshold * 10**6) * (len(numbers[i]) + len(other) - shared)
        marks[numbers[i]] = False
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row number of each row's component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


def join_id() -> Column:
    """The document's id; for a row without one, a number made from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def text_key(text: Column) -> Column:
    """Stands for the text as it is written, by two independent hashes."""
    return F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit(77), text))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, jid, raw, k, sketch`` of each document; ``raw`` stands for its text, ``k`` for the sequence of its words, and texts without
    words have no sketch."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column("text")):
                k, s = [], []
                for t in texts:  # the words of one text at a time
                    w = normal_words(t)
                    k.append(xxhash.xxh3_128_digest(b" ".join(w)))
                    s.append(sketch(shingles(w, size)).tobytes() if w else None)
                own = [b.column(c).slice(at, len(texts)) for c in ("doc_id", "jid", "raw")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(k, pa.binary()), pa.array(s, pa.binary())], ["doc_id", "jid", "raw", "k", "sketch"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumns({"jid": join_id(), "raw": text_key(F.col("text"))}).select("doc_id", "jid", "raw", "text").mapInArrow(each, "doc_id long, jid long, raw string, k binary, sketch binary")


def _blocks(texts: DataFrame, block: int) -> DataFrame:
    """A row for each text, shared band value and pair of blocks it belongs to."""

    def bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(-1, BANDS)
            with np.errstate(over="ignore"):
                keys = mix(s + mix(np.arange(BANDS, dtype=np.uint64))[None, :]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("k"), lists], ["k", "keys"])

    own = texts.select("k", "sketch").mapInArrow(bands, "k binary, keys array<long>").select("k", F.posexplode("keys").alias("band", "key"))
    shared = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = own.join(shared, "key").join(texts.select("k", "sketch", "copies"), "k")
    blocks = F.ceil(F.col("n") / block).cast("int")
    found = found.withColumn("own", F.pmod(F.xxhash64("k"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return found.select("key", "band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "k", "sketch", "copies")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "k")


def _held_texts(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """``k, words`` of the wanted texts (``jid, k``). A bit filter of fixed size keeps most others out of the shuffle."""
    place = F.pmod(F.xxhash64("jid"), F.lit(bits))
    # Bit positions of the built-in functions run from 1, 32,768 to a map.
    maps = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    held = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for r in maps.collect():  # of 4 KB each, bits / 8 bytes in all; an iterator would run a job for each partition
        held[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(r.m)] = np.frombuffer(bytes(r.m), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def maybe(p: pa.Array) -> pa.Array:
        x = p.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("jid", join_id())
    near = rows.select("jid", "text").where(maybe(F.pmod(F.xxhash64("jid"), F.lit(bits))))
    # Ids may be repeated with other texts: the key of the words decides.
    found = near.join(wanted.select("jid", F.col("k").alias("k_")), "jid")

    def same(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column("text")):
                words = [b" ".join(normal_words(t)) for t in texts]
                k = [xxhash.xxh3_128_digest(w) for w in words]
                pick = [i for i, (x, y) in enumerate(zip(k, b.column("k_").slice(at, len(texts)).to_pylist(), strict=True)) if x == y]
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for i in pick], pa.binary()), pa.array([words[i] for i in pick], pa.binary())], ["k", "words"])

    return found.select("k_", "text").mapInArrow(same, "k binary, words binary").groupBy("k").agg(F.min("words").alias("words"))


def links(docs: DataFrame, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, block: int = BLOCK, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with the key of their text, texts with the number of their copies, links by text).

    A row of the last has a text's ``k``, the number of documents with other texts linked to it within one piece of work, and the ``root``
    it is connected to there.
    """
    spark = docs.sparkSession
    rows = table_written(sketched(docs, size), "jaccard")
    # Written as well, as it is read in each of the plans that follow: they are planned anew in the driver after every stage of theirs.
    texts = table_written(rows.groupBy("k").agg(F.min("jid").alias("jid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "jaccard")
    need = least_matches(threshold, tolerance)

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            left, right = _survivors(t, need)
            used = np.unique(np.concatenate([left, right]))
            if len(used):
                yield from t.take(pa.array(used)).to_batches()

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (piece for groups in _groups(batches) for piece in _pieces(groups, "words")):
            left, right = _survivors(t, need)
            grams = [shingles(w.split(b" "), size) for w in t.column("words").to_pylist()]
            ok = verified(grams, left, right, threshold)
            left, right = left[ok], right[ok]
            if not len(left):
                continue
            copies, k = t.column("copies").to_numpy(), t.column("k")
            n = np.zeros(t.num_rows, np.int64)
            np.add.at(n, left, copies[right])
            np.add.at(n, right, copies[left])
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([k.take(pa.array(used)).combine_chunks(), pa.array(n[used]), k.take(pa.array(_roots(t.num_rows, left, right)[used])).combine_chunks()], ["k", "n", "root"])

    schema = "key long, band int, bi int, bj int, own int, k binary, sketch binary, copies long"
    work = _grouped(_blocks(texts.where("sketch is not null"), block))
    left_over = table_written(work.mapInArrow(prune, schema), "jaccard")
    wanted = left_over.select("k").distinct().join(texts.select("k", "jid"), "k").select("jid", "k")
    held = _held_texts(docs, wanted, bits)
    found = _grouped(left_over.join(held, "k").select("key", "band", "bi", "bj", "own", "k", "sketch", "copies", "words")).mapInArrow(verify, "k binary, n long, root binary")
    return rows, texts.select("k", "least", "copies"), table_written(found, "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """``k, root``: the least member of each node's component, from ``k, root`` pairs, by alternating large and small stars.

    Each step only takes minima by key and joins them back, and is written, so that neither a large component nor a lost
    executor makes it slow. Nodes without edges do not occur.
    """
    e = edges.select(F.col("k").alias("a"), F.col("root").alias("b")).where("a != b").distinct()
    last = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        e = table_written(small.where("a != b").distinct(), "jaccard")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("a").alias("k"), F.col("b").alias("root"))
        last = now


def _classes(docs: DataFrame, **options: object) -> DataFrame:
    """``doc_id, jid, raw, root, class_id, n_links, n_copies`` of each document; ``root`` stands for the class."""
    rows, texts, found = links(docs, **options)
    roots = components(found)
    n = found.groupBy("k").agg(F.sum("n").alias("n_links"))
    joined = table_written(texts.join(n, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), "jaccard")
    least = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = joined.join(least, "root").select("k", "root", F.coalesce("n_links", F.lit(0)).alias("links"), "copies", "class_id")
    # Documents of the same words but other texts are links, of similarity 1; without words there are no n-grams to share.
    written = rows.groupBy("k", "raw").agg(F.count("*").alias("same"), F.max(F.col("sketch").isNotNull()).alias("worded"))
    alike = F.when(F.col("worded"), F.col("copies") - F.col("same")).otherwise(0)
    each = written.join(classes, "k").select("k", "raw", "root", "class_id", (F.col("links") + alike).alias("n_links"), (F.col("same") - 1).alias("n_copies"))
    return rows.select("doc_id", "jid", "raw", "k").join(each, ["k", "raw"]).select("doc_id", "jid", "raw", "root", "class_id", "n_links", "n_copies")


def jaccard_classes(docs: DataFrame, **options: object) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of each document, with ``jid``.

    ``class_id``: the least id among the documents connected by links or equal texts. ``n_links``: documents with other texts
    and a similarity of the threshold or more, those of the same words included. ``n_copies``: further documents with the same text.
    """
    return _classes(docs, **options).select("doc_id", "class_id", "n_links", "n_copies", "jid")


def without_near_copies(docs: DataFrame, **options: object) -> DataFrame:
    """One document of each class stays: the one with the least id, of several texts with it the one with the least key. Rows without an
    id stay if no other of their class has one, one of them.

    Repeated rows of one id and text count as one document.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("x")
    keep = _classes(docs, **options).groupBy("root").agg(first).select(F.col("x.doc_id").alias("__first"), F.col("x.raw").alias("__text"))
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__raw": text_key(F.coalesce(F.col("text"), F.lit("")))})
    return rows.join(keep, F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__raw") == F.col("__text")), "left_semi").dropDuplicates(["__id", "__raw"]).select(*docs.columns)
