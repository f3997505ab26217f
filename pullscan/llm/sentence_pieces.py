"""SentencePiece encoding and decoding of whole texts with a merge-type model.

Merging always joins the adjacent pair of the best score, the leftmost of equal ones, whose joined text is a piece. A row of pieces is what
this leads to exactly if each two neighbours, joined and merged again from their characters, come out as the same two pieces: merges
inside a stretch go on in the same order whatever stands around it, so the first merge across a border would show in the two
pieces alone. No order of the scores is needed for that.

Encoding therefore goes from left to right without merging the text: an Aho-Corasick pass gives the longest piece at
each place, the piece is taken if it is compatible with the one before it, else the next shorter one is tried. A place from which there is no
way on is set in a bitfield and never entered again: all rows of compatible pieces up to a place are the same one, so the place fails
whatever was tried before. Compatibility is remembered for each pair.

No piece goes on from other characters to white space, and none holds a line feed, so a text is parted there (checked when the model
is read; of another model the whole text is one part). Each different part is encoded once while it is remembered. Characters
without a piece become their bytes, or the unknown piece in a model without bytes.

Defined results: a null text is an empty one, without ids. Null or repeated ids of documents stay as they are, one row for each row.
A very long text is encoded as a whole, part by part; other columns, whatever their names, take no part. An empty table
gives no rows. Only models without a character map are read, since the text is not normalised; any other raises.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pullscan.llm.common import id_and_text, slices

MODEL = "piece_bpe_32k.model"
SCHEMA = "doc_id long, ids array<int>, decoded string"
SPACE = "▁"
#: Different parts, and pairs of pieces, that a worker holds in the newer half of its memory. When that is full it becomes the
#: older half, from which what is met again comes back; the older half before it is forgotten.
PARTS, PAIRS = 600_000, 500_000
# Types of pieces in the model file, and what an unknown piece is decoded to.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT = " ⁇ "


def merged(text: Sequence[str], ranks: dict[str, int]) -> list[str]:
    """What merging leads to, step by step. For short texts: pieces and pairs of pieces."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Memory(dict):
    """What is remembered of a function: a newer and an older half of at most ``limit`` results each."""

    def __init__(self, function, limit: int) -> None:
        super().__init__()
        self.function, self.limit, self.older = function, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Bitfield:
    """One bit per place of a text."""

    def __init__(self, n: int) -> None:
        self.bytes = bytearray((n >> 3) + 1)

    def set(self, i: int) -> None:
        self.bytes[i >> 3] |= 1 << (i & 7)

    def __contains__(self, i: int) -> bool:
        return bool(self.bytes[i >> 3] >> (i & 7) & 1)


class Pieces:
    """A merge-type model: pieces by their text, the search structure, and both directions."""

    def __init__(self, path: str, parts: int = PARTS, pairs: int = PAIRS) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        rule = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models that leave texts as they are")
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces have further rules")
        self.prefix = " " if rule.add_dummy_prefix else ""
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        order = {s: r for r, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        ranks = {p: order[s] for _, p, s in normal}
        #: Only pieces that merging makes of their own characters can come out of it.
        self.id = {p: i for i, p, _ in normal if merged(p, ranks) == [p]}
        self.text = {i: p for p, i in self.id.items()}
        self.ranks = ranks
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.of_byte = of_byte if model.trainer_spec.byte_fallback and len(of_byte) == 256 else None
        self._search(normal)
        self._decoding(model)
        self.parts, self.pairs = Memory(self._ids, parts), Memory(self._stay, pairs)

    def _search(self, normal: list[tuple[int, str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: The longest piece that a piece begins with, other than itself: what is tried after it.
        self.shorter = {i: next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) for p, i in self.id.items()}
        self.length = {i: len(p) for p, i in self.id.items()}
        texts = [p for _, p, _ in normal]
        whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in texts)
        self.cut = re.compile(r"(?s).+" if whole else r" *[^ \n]+|\n| +")

    def _decoding(self, model) -> None:
        self.bytes = []
        for p in model.pieces:
            if p.type == CONTROL:
                self.bytes.append(b"")
            elif p.type == UNKNOWN:
                self.bytes.append(UNKNOWN_TEXT.encode())
            elif p.type == BYTE:
                self.bytes.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.bytes.append(p.piece.replace(SPACE, " ").encode())
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.spaced = {i for i, p in enumerate(model.pieces) if p.type == NORMAL and p.piece.startswith(SPACE)}

    def _stay(self, pair: int) -> bool:
        """Whether two neighbours stay as they are when their characters are merged again."""
        a, b = self.text[pair >> 32], self.text[pair & 0xFFFFFFFF]
        return merged(a + b, self.ranks) == [a, b]

    def compatible(self, left: int, right: int) -> bool:
        return self.pairs[left << 32 | right]

    def _part(self, text: str) -> list[int]:
        """The ids of one part, with white space escaped."""
        n = len(text)
        longest = array("i", [-1]) * (n + 1)
        for end, (i, length) in self.automaton.iter(text):
            longest[end - length + 1] = i  # the end grows, so the last one is the longest
        out: list[int] = []  # a character without a piece is held as -1 - its code point
        places: list[int] = []
        failed = Bitfield(n + 1)
        at, candidate = 0, longest[0]
        while at < n:
            if candidate < 0 and longest[at] < 0:
                out.append(-1 - ord(text[at]))  # stands alone: merging cannot join it to anything
                places.append(at)
                at += 1
                candidate = longest[at]
                continue
            while candidate >= 0:
                end = at + self.length[candidate]
                if end not in failed and (not out or out[-1] < 0 or self.compatible(out[-1], candidate)):
                    break
                candidate = self.shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                places.append(at)
                at = end
                candidate = longest[at]
            else:
                failed.set(at)
                if not out or out[-1] < 0:
                    raise ValueError("no row of pieces: the model's pieces are not made by its merges")
                at = places.pop()
                candidate = self.shorter[out.pop()]
                if candidate < 0:  # nothing shorter: the next round fails this place as well
                    failed.set(at)
        return out

    def _ids(self, part: str) -> bytes:
        """The ids of a part of a text, as 32-bit numbers."""
        ids: list[int] = []
        for i in self._part(part.replace(" ", SPACE)):
            if i >= 0:
                ids.append(i)
            elif self.of_byte is None:
                ids.append(self.unknown)
            else:
                ids += [self.of_byte[b] for b in chr(-1 - i).encode()]
        if self.of_byte is None:  # neighbouring unknown characters are one unknown piece
            ids = [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != self.unknown]
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        parts = self.cut.findall(self.prefix + text.replace(SPACE, " "))
        return np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), "<i4")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. Bytes that form no character become U+FFFD, one for each byte."""
        if not self.control.isdisjoint(ids):  # bytes on both sides of a control piece form no character together
            runs: list[list[int]] = [[]]
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
            first = next((r for r in runs if r), [])
            return "".join(self._decoded(r, r is first) for r in runs)
        return self._decoded(ids, True)

    def _decoded(self, ids: Sequence[int], begins: bool) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if begins and self.prefix and len(ids) and ids[0] in self.spaced:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", _each_byte())


@lru_cache(maxsize=1)
def _each_byte() -> str:
    import codecs

    codecs.register_error("one-mark-per-byte", lambda e: ("�" * (e.end - e.start), e.end))
    return "one-mark-per-byte"


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode_and_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, the ``ids`` of the whole text without begin or end ids, and the text they are ``decoded`` to.

    ``model`` names a file of the public vocabularies, which every executor has at its own path.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        pieces = pieces_of(public_tokenizers.path(model))
        for b in batches:
            for at, texts in slices(b.column("text")):
                ids = [pieces.encode(t.decode()) for t in texts]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                decoded = [pieces.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(each, SCHEMA)
