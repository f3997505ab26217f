"""Removal of repeated passages with difference-cover anchors.

A passage of ``window`` words that starts in a document with a smaller id is removed from the later ones. Not all windows are compared:
only runs of ``window - period + 1`` words that begin at cover positions modulo the period are hashed. For any two places there
is a shift below the period that takes both to cover positions, so two equal windows always share an aligned anchor. Where
an anchor occurs in two documents, it is extended to all windows around it, and only these are compared by their whole word
sequence.

Work goes by chunks of documents (by hash of the id, some megabytes each). A chunk sends each anchor hash once, however often it
occurs, packed by hash range; back come those that other chunks have too. The windows around them take the same way. So a
passage that a third of all documents share costs one number per chunk. Texts are shuffled once, to their chunks.

Windows are equal if 64 bits of hash and their hash range agree. Defined results: a null or empty text has no words. Rows without an
id keep all words and remove none elsewhere; rows of one id never remove from each other. Texts of any length count with all
their windows. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import byte_texts, id_and_text, window_hashes, word_hashes

#: Perfect difference covers by period: every difference modulo the period is one of two members. Fixed values.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
CHUNK_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
PACKED = "range int, chunk int, data binary"
NAMES = ["range", "chunk", "data"]


class Chunk:
    """The documents of a chunk as one row of word hashes."""

    def __init__(self, t: pa.Table) -> None:
        self.ids = t.column("doc_id").to_pylist()
        self.words = [x.split() for x in byte_texts(t.column("text"))]
        flat = [w for ws in self.words for w in ws]
        self.hashes = word_hashes(flat)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        known = np.array([i is not None for i in self.ids], bool)
        self.id_of = np.array([0 if i is None else i for i in self.ids], np.int64)[doc]
        self.at = np.arange(len(flat)) - self.begins[doc]  # place in the document
        # Words from here to the document's end; none for documents that take no part.
        self.left = np.where(known[doc], self.ends[doc] - np.arange(len(flat)), 0)

    def anchors(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each anchor."""
        size = window - period + 1
        h = window_hashes(self.hashes, size, seed=1)
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        first = np.flatnonzero(cover[self.at[: len(h)] % period] & (self.left[: len(h)] >= size))
        return first, h[first]

    def windows(self, window: int, first: np.ndarray | None, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash and range of the windows that begin at ``first`` (default: of all windows)."""
        h = window_hashes(self.hashes, window, seed=2)
        if first is None:
            first = np.flatnonzero(self.left[: len(h)] >= window)
        other = window_hashes(self.hashes, window, seed=3)
        return first, h[first], (other[first] % np.uint64(ranges)).astype(np.int64)


def _pack(ranges: np.ndarray, chunk: int, *columns: np.ndarray) -> pa.Table:
    """One row per range, with the columns' values one after another."""
    order = np.argsort(ranges, kind="stable")
    ranges, columns = ranges[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist() + [len(ranges)]
    data = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([pa.array(ranges[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(data), chunk, np.int32)), pa.array(data, pa.binary())], names=NAMES)


def _repeated_anchors(t: pa.Table) -> pa.Table:
    """Of each chunk's anchors in this range, those that another chunk has as well."""
    sets = [np.frombuffer(x, np.uint32) for x in t.column("data").to_pylist()]
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    often = values[n > 1]
    kept = [s[np.isin(s, often, assume_unique=True)] for s in sets]
    rows = [(r, c, k.tobytes()) for r, c, k in zip(t.column("range").to_pylist(), t.column("chunk").to_pylist(), kept, strict=True) if len(k)]
    return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=NAMES)


def _later_windows(t: pa.Table) -> pa.Table:
    """Of each chunk's windows in this range, those that a smaller id of another chunk has."""
    hashes, ids, sizes = [], [], []
    for x in t.column("data").to_pylist():
        both = np.frombuffer(x, np.uint64)
        hashes.append(both[: len(both) // 2])
        ids.append(both[len(both) // 2 :].view(np.int64))
        sizes.append(len(both) // 2)
    every, own = np.concatenate(hashes), np.concatenate(ids)
    _, at = np.unique(every, return_inverse=True)
    least = np.full(at.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, own)
    later, ends, rows = own > least[at], np.cumsum(sizes), []
    for r, c, h, e, n in zip(t.column("range").to_pylist(), t.column("chunk").to_pylist(), hashes, ends, sizes, strict=True):
        k = h[later[e - n : e]]
        if len(k):
            rows.append((r, c, k.tobytes()))
    return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=NAMES)


def _known(t: pa.Table, kind: type) -> dict[int, np.ndarray]:
    """What came back for a chunk, by range."""
    return {r: np.frombuffer(x, kind) for r, x in zip(t.column("range").to_pylist(), t.column("data").to_pylist(), strict=True)}


def _in_ranges(ranges: np.ndarray, values: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Which values are among those known for their range."""
    out = np.zeros(len(values), bool)
    if not known or not len(values):
        return out
    order = np.argsort(ranges, kind="stable")
    cuts = np.searchsorted(ranges[order], np.array([[r, r + 1] for r in known]))
    for (a, b), k in zip(cuts, known.values(), strict=True):
        at = order[a:b]
        out[at] = np.isin(values[at], k)
    return out


def _least_ids(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each hash (the position of one such) the least id, and each row's least id."""
    _, one, at = np.unique(hashes, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, at, ids)
    return one, least, least[at]


def dedup_substrings(docs: DataFrame, window: int = 13, period: int = 7, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document; ``with_text`` adds ``kept_text``."""
    if period not in COVERS or period > window:
        raise ValueError(f"period: one of {sorted(COVERS)}, at most the window")
    rows = id_and_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, ranges = max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / range_bytes))
    # Rows without an id are dealt by their text.
    dealt = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(chunks)).cast("int")
    rows = rows.withColumn("chunk", dealt)

    def split(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64), h.astype(np.uint32)

    def send_anchors(t: pa.Table) -> pa.Table:
        _, h = Chunk(t).anchors(window, period)
        return _pack(*(lambda r, v: (r, t.column("chunk")[0].as_py(), v))(*split(np.unique(h))))

    def send_windows(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.binary())], names=NAMES)
        c = Chunk(t)
        first, h = c.anchors(window, period)
        _, least, own = _least_ids(h, c.id_of[first])
        _, most, _ = _least_ids(h, -c.id_of[first])
        inside = np.isin(h, np.unique(h)[least != -most])  # in two documents of this chunk
        first = first[inside | _in_ranges(*split(h), _known(back, np.uint32))]
        begins = (first[:, None] - np.arange(window - len_anchor + 1)[None, :]).ravel()
        begins = begins[begins >= 0]
        # The window must begin in the anchor's document, which has words enough from there.
        begins = np.unique(begins[c.left[begins] >= window])
        begins, g, r = c.windows(window, begins, ranges)
        one, ids, _ = _least_ids(g, c.id_of[begins])
        return _pack(r[one], t.column("chunk")[0].as_py(), g[one], ids.view(np.uint64))

    len_anchor = window - period + 1

    def remove(t: pa.Table, back: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows:
            c = Chunk(t)
            begins, g, r = c.windows(window, None, ranges)
            ids = c.id_of[begins]
            later = (ids > _least_ids(g, ids)[2]) | _in_ranges(r, g, _known(back, np.uint64))
            edge = np.zeros(len(c.hashes) + 1, np.int64)
            np.add.at(edge, begins[later], 1)
            np.add.at(edge, begins[later] + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, (ws, a, b) in enumerate(zip(c.words, c.begins, c.ends, strict=True)):
                kept = b" ".join([w for w, x in zip(ws, gone[a:b].tolist(), strict=True) if not x]) if gone[a:b].any() else b" ".join(ws)
                out.append((c.ids[i], len(ws), int(gone[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    by_chunk = rows.groupBy("chunk")
    both: Callable = lambda back, f, schema: by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(f, schema)
    anchors = by_chunk.applyInArrow(send_anchors, PACKED).groupBy("range").applyInArrow(_repeated_anchors, PACKED)
    windows = both(anchors, send_windows, PACKED).groupBy("range").applyInArrow(_later_windows, PACKED)
    result = both(windows, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)
    return result.withColumn("kept_text", F.decode("kept", "utf-8")).drop("kept") if with_text else result
