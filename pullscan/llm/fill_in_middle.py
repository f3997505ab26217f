"""Fill-in-middle: each text is cut at two unit borders and its parts are written in another order between markers.

The UTF-8 bytes of a run of texts become one sequence over six character classes, held in a wavelet matrix: one bit vector per
level with the number of set bits before each 64-bit word. The rank of a class up to a place is its count there. Ranks of the
classes that end a unit add up to the number of units, ranks of the continuation bytes to the difference between bytes and code
points. The units of a text are a difference of two such sums, and each cut is found by bisection on them, for all texts
of a run at once.

A unit is a word with the white space in front of it, or white space that ends the text; white space is space and U+0009 to
U+000D. Which units begin the middle and the suffix, and the form, follow from a hash of the seed and the id alone.

Defined results: a null text is an empty one and stays plain, as does a text that holds a marker. A null id hashes as an empty
string. Repeated rows are each cut alike. Texts of any length are whole; a run holds about 1 MB of texts, or one longer text. Other columns,
whatever their names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import id_and_text, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: Classes of bytes: inside a word, continuation byte inside a word, the same two as the last byte of a word, white space, and the last byte of
#: white space that ends a text.
WORD, WORD_MORE, LAST, LAST_MORE, WHITE, TAIL = range(6)
LEVELS = 3
UNIT_ENDS, CONTINUATIONS = (LAST, LAST_MORE, TAIL), (WORD_MORE, LAST_MORE)


class BitVector:
    """Bits with the number of set ones before each word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(8 - len(packed) % 8, np.uint8)).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, place: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` bits are set."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels`` in a sequence; about two bits of memory per symbol and level."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(levels - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, BitVector(bits), int(len(bits) - np.count_nonzero(bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place``."""
        first, last = np.zeros_like(place), place
        for shift, bits, zeros in self.levels:
            f, t = bits.ones(first), bits.ones(last)
            first, last = (zeros + f, zeros + t) if symbol >> shift & 1 else (first - f, last - t)
        return last - first

    def ranks(self, symbols: Sequence[int], place: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, place) for s in symbols)


def classes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that stand one after another; ``ends`` has the end of each."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    at_end = np.zeros(len(data) + 1, bool)
    at_end[ends] = True
    at_end = at_end[1:]
    closes = at_end.copy()
    closes[:-1] |= white[1:]
    more = (data & 0xC0) == 0x80
    return np.where(white, WHITE + at_end, more + 2 * closes).astype(np.uint8)


class Units:
    """The units of a run of texts."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.end = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begin = np.concatenate([[0], self.end[:-1]]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        # An empty text ends where the one before it does, so only ends of texts with bytes are marked.
        self.matrix = WaveletMatrix(classes(data, self.end[self.end > self.begin]), LEVELS)
        self.first = self.upto(self.begin)
        self.n = self.upto(self.end) - self.first

    def upto(self, place: np.ndarray) -> np.ndarray:
        return self.matrix.ranks(UNIT_ENDS, place)

    def code_points(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        more = self.matrix.ranks(CONTINUATIONS, np.concatenate([begin, end]))
        return end - begin - (more[len(begin) :] - more[: len(begin)])

    def after(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units`` units of each text end: the first place with so many unit ends before it."""
        low, high, wanted = self.begin.copy(), self.end.copy(), self.first + units
        while (low < high).any():
            half = (low + high) >> 1
            enough = self.upto(half) >= wanted
            high = np.where(enough, half, high)
            low = np.where(enough, low, np.minimum(half + 1, high))
        return low


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, percent_spm: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``percent`` of the texts are rearranged, of these ``percent_spm`` with the suffix first (``spm``), the others with the
    prefix first (``psm``); the rest is ``plain`` and its output is the text.
    """
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = markers

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ids = b.column("doc_id").to_pylist()
            for at, texts in slices(b.column("text")):
                ids, units = all_ids[at : at + len(texts)], Units(texts)
                h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
                marked = np.array([not t or any(x in t for x in markers) for t in texts], bool)
                plain = marked | (h[:, 2] % 100 >= percent)
                spm = ~plain & (h[:, 3] % 100 < percent_spm)
                one, two = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
                a, c = units.after(np.minimum(one, two)), units.after(np.maximum(one, two))
                before, between = units.code_points(units.begin, a), units.code_points(a, c)
                out = []
                for t, x, y, whole, suffix_first in zip(texts, (a - units.begin).tolist(), (c - units.begin).tolist(), plain.tolist(), spm.tolist(), strict=True):
                    if whole:
                        out.append(t)
                    elif suffix_first:
                        out.append(b"".join((s, t[y:], p, t[:x], m, t[x:y])))
                    else:
                        out.append(b"".join((p, t[:x], s, t[y:], m, t[x:y])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), pa.array(units.n), pa.array(form.tolist(), pa.string()),
                     pa.array(before, mask=plain), pa.array(between, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return id_and_text(docs).mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. No part holds a marker, so the markers part it."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
