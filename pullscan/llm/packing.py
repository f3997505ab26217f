"""Packing by concatenating and cutting.

Pass one tokenises each document once and writes the ids with their place inside the task's own stream. The totals of the
tasks (one number each) are summed up to the global offset of every task. Pass two cuts the one long stream into windows of
equal length: a document lies in the windows its offsets touch. Windows that end inside a task are complete there; only the
first and last window of a task are parted between tasks, and only these boundary records are shuffled.

Defined results: a null text is an empty one, which has the end id alone. A null or repeated ``doc_id`` is kept as it is; each
row is packed once. Texts of any length are parted over windows. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pullscan.llm.common import id_and_text, slices
from pullscan.session import shared_path

STREAM = "part int, first long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"
#: Distinct words, and pieces of words, whose ids a worker holds in the newer half of its memory. A full half becomes the older
#: one, from which what is met again comes back; so rare words are forgotten, and frequent ones stay.
WORDS, PIECE_WORDS = 300_000, 200_000
#: Bytes of texts in a run, whose different words are met once.
RUN = 3 << 20
#: Letters below U+0250, which lower-casing leaves one letter each, with ASCII marks behind them: two pieces of the word tokenizer.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]*[!-/:-@\[-`{-~]*$"


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Memory:
    """Ids by word, in a newer and an older half."""

    def __init__(self, limit: int) -> None:
        self.limit, self.newer, self.older = limit, {}, {}

    def recall(self, words: list[str]) -> list[bytes | None]:
        """The ids of these words; none for one never met, or forgotten."""
        if len(self.newer) >= self.limit:
            self.older, self.newer = self.newer, {}
        found = list(map(self.newer.get, words))
        for i, ids in enumerate(found):
            if ids is None and (ids := self.older.get(words[i])) is not None:
                found[i] = self.newer[words[i]] = ids
        return found


class Encoder:
    """Ids of whole texts by a tokenizer whose pieces never cross white space.

    Arrow parts a run of texts at white space and numbers its different words, each of which is looked up once a run and encoded
    where it is not remembered, many at a time. Plain words are two pieces, letters and marks, remembered as well and
    encoded with spaces between, where an id that ends a piece parts them again. Any other word is parted from the next by a special
    token. A text that spells a special token is left to the tokenizer as a whole.
    """

    def __init__(self, path: str, memory: int = WORDS, pieces: int = PIECE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.special = [s.encode() for s, _ in special]
        self.part, self.part_id = special[-1]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.pieces = Memory(memory), Memory(pieces)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _runs(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids up to each end, as bytes."""
        data, places = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *places[:-1]], places, strict=True)]

    def learn(self, words: pa.Array) -> list[bytes]:
        """The ids of words that hold no ASCII white space."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.not_equal(pc.binary_length(words), 0)).to_numpy(zero_copy_only=False)
        out = np.full(len(words), b"", object)
        some = words.filter(pa.array(plain))
        if len(some):
            bare = pc.utf8_rtrim(some, characters=MARKS)
            letters = strings(pc.utf8_lower(bare))
            marks = [w[n:] for w, n in zip(strings(some), pc.utf8_length(bare).to_numpy().tolist(), strict=True)]
            named = list({*letters, *marks} - {""})
            known = dict(zip(named, self.pieces.recall(named), strict=True))
            known[""] = b""
            new = [p for p, ids in known.items() if ids is None]
            if new:
                ids = self._ids(" ".join(new))
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(new):
                    raise ValueError("a piece without an end")
                learned = dict(zip(new, self._runs(ids, ends), strict=True))
                known.update(learned)
                self.pieces.newer.update(learned)
            out[plain] = [known[x] + known[m] for x, m in zip(letters, marks, strict=True)]
        odd = strings(words.filter(pa.array(~plain)))
        if odd:
            ids = self._ids(self.part.join(odd) + self.part)
            out[~plain] = [r[: -self.kind.itemsize] for r in self._runs(ids, np.flatnonzero(ids == self.part_id) + 1)]
        return out.tolist()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        width = self.kind.itemsize
        odd = {i: self._ids(t.decode()).tobytes() for i, t in enumerate(texts) if any(s in t for s in self.special)}
        lists = pc.ascii_split_whitespace(pa.array([b"" if i in odd else t for i, t in enumerate(texts)], pa.large_binary()).cast(pa.large_string()))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary
        known = self.words.recall(named := strings(words))
        unknown = [i for i, x in enumerate(known) if x is None]
        for i, ids in zip(unknown, self.learn(words.take(pa.array(unknown, pa.int64()))), strict=True):
            known[i] = self.words.newer[named[i]] = ids
        # Taken in the order of the words, the ids lie one behind the other.
        lengths = np.array([len(x) for x in known], np.int64)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        data = b"".join(pa.array(known, pa.large_binary()).take(flat.indices).buffers()[2:] if len(flat) else [])
        counts = np.diff(ends)
        if odd:
            parts = [odd.get(i, data[ends[i] : ends[i + 1]]) for i in range(len(texts))]
            data, counts = b"".join(parts), np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(data, self.kind, count=int(counts.sum()) // width), counts // width


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_stream(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pass one, written: each document's ids with ``end_id`` behind them, and where they begin in the task's own stream.

    ``tokenizer`` names a file of the public vocabularies, which every executor has at its own path.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = _encoder(public_tokenizers.path(tokenizer))
        part, first = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, texts in slices(b.column("text"), RUN):
                ids, counts = coder.encode(texts)
                ends = np.cumsum(counts)
                rows = [np.append(ids[e - c : e], coder.kind.type(end_id)).tobytes() for e, c in zip(ends, counts, strict=True)]
                n = counts + 1
                begins = first + np.cumsum(n) - n
                first += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(begins.astype(np.int64)), b.column("doc_id").slice(i, len(n)), pa.array(n.astype(np.int64)), pa.array(rows, pa.binary())], ["part", "first", "doc_id", "n", "ids"])

    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    id_and_text(docs).mapInArrow(encode, STREAM).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def with_offsets(stream: DataFrame) -> DataFrame:
    """Pass two's input: each row's global ``place``, and the ``total`` of all ids.

    The totals are one row per writing task, whatever the input; their number is the bound of what is broadcast.
    """
    totals = stream.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("n"))
    every = Window.orderBy("part")
    base = totals.select("part", (F.sum("n").over(every) - F.col("n")).alias("base"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return stream.join(F.broadcast(base), "part").withColumn("place", F.col("base") + F.col("first"))


def cut(stream: DataFrame, window: int, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, one per window it touches.

    ``padded_to``: the window's length, unless the sequence's own number of ids is a power of two, which is left unpadded.
    ``with_ids`` adds the ids as bytes, of which a ``numpy`` type's width is ``length(ids) / length``.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            place, n, total = (b.column(c).to_numpy() for c in ("place", "n", "total"))
            first, last = place // window, (place + n - 1) // window
            times = last - first + 1
            row = np.repeat(np.arange(len(n)), times)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            begin = np.maximum(place[row], sequence * window)
            length = np.minimum(place[row] + n[row], (sequence + 1) * window) - begin
            start = begin - place[row]
            size = np.minimum(window, total[row] - sequence * window)
            ids, sums, own = b.column("ids"), np.zeros(len(row), np.int64), []
            held, at = b"", -1
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != at:
                    held, at = ids[r].as_py(), r
                    width = len(held) // int(n[r])
                part = held[s * width : (s + m) * width]
                sums[k] = zlib.crc32(np.frombuffer(part, f"<u{width}").astype("<u4").tobytes())
                if with_ids:
                    own.append(part)
            columns = [b.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, sums, n[row], sequence, begin - sequence * window, size, np.where(size & (size - 1) == 0, size, window)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names)

    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return stream.select("doc_id", "n", "place", "total", "ids").mapInArrow(pieces, schema)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of ``window`` ids; only the last sequence can be shorter."""
    return cut(with_offsets(token_stream(docs, tokenizer, end_id)), window, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, n`` from ``pack(..., with_ids=True)``: complete windows straight from the task that holds all of
    them, the rest from the boundary records, which alone are shuffled. A window bounds what is gathered for it."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(done: dict[int, list]) -> pa.RecordBatch:
            rows = [(s, o, n, x, sum(p[1] for p in ps) == size, size) if len(ps) == 1 else (s, ps[0][0], sum(p[1] for p in ps), b"".join(p[2] for p in ps), sum(p[1] for p in ps) == size, size) for s, ps in done.items() for o, n, x, size in ps[:1]]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

        for b in batches:
            for s, o, n, x, size in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "ids", "sequence_tokens")), strict=True):
                held.setdefault(s, []).append((o, n, x, size))
            latest = max(held, default=None)
            done = {s: p for s, p in held.items() if s != latest}
            if done:
                yield out(done)
            held = {s: p for s, p in held.items() if s == latest}
        if held:
            yield out(held)

    names = ["sequence_id", "offset", "n", "ids", "complete", "size"]
    kinds = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("complete", pa.bool_()), ("size", pa.int64())])
    runs = pieces.mapInArrow(whole, "sequence_id long, offset long, n long, ids binary, complete boolean, size long")
    edges = runs.where("not complete").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("n").alias("n"))
    # Binary columns are joined by their hexadecimal digits: the built-in concat takes a fixed number of arguments.
    joined = edges.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"), "n")
    return runs.where("complete").select("sequence_id", "ids", "n").unionByName(joined)
