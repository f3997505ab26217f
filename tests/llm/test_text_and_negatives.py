"""Hard negatives, SentencePiece and fill-in-middle against brute force, the library itself and exact round trips."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pullscan.llm import fill_in_middle as fim
from pullscan.llm import hard_negatives as hn
from pullscan.llm import sentence_pieces as sp

DOCS = "doc_id long, text string, form string, output string, ids string, n long, r long"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def scraps(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab é漢𝄞 \n\t\x0b\x0c\r\x85 ▁\x00 e") for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 3000)}" + "\n" * (rng.random() < 0.05) for _ in range(60_000))
    odd = [None, "", " ", "\n", "a", " a", "a ", "<P>", "x <S> y", "no <M> here", "<s> <S", "<P", "x" * 50_000, " " * 3000, long, "a <"]
    return scraps(1, 60) + odd + [long[:500]] * 3


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i % 17 == 16 else i, t, "f", "o", "i", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], DOCS).repartition(3)


# ------------------------------------------------------------------------------------------ fill-in-middle


def cut(doc_id, text, seed=42, percent=50, spm=80):
    """The rearranged text by its definition."""
    text = text or ""
    units = re.findall(UNIT, text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("percent", "spm"), [(50, 80), (100, 50)])
def test_fill_in_middle(spark, docs, texts, percent, spm):
    got = fim.fill_in_middle(docs, percent=percent, percent_spm=spm).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    ids = [None if i % 17 == 16 else i for i in range(len(texts))]
    want = Counter((i, *cut(i, t, percent=percent, spm=spm)) for i, t in [*zip(ids, texts, strict=True), (3, texts[3])])
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in [*zip(ids, texts, strict=True), (3, texts[3])])
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_other_seed_other_cuts(spark, docs):
    a, b = (fim.fill_in_middle(docs, seed=s).groupBy().agg(F.sum(F.hash("output"))).first()[0] for s in (42, 43))
    assert a != b


def test_ranks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 6, n).astype(np.uint8)
        m = fim.WaveletMatrix(x, 3)
        at = np.arange(n + 1)
        for c in range(6):
            assert m.rank(c, at).tolist() == np.concatenate([[0], np.cumsum(x == c)]).tolist()


def test_cuts_of_runs():
    rng = random.Random(5)
    for _ in range(60):
        texts = scraps(rng.random(), rng.randint(1, 9))
        units = fim.Units([t.encode() for t in texts])
        tokens = [re.findall(UNIT, t) for t in texts]
        assert units.n.tolist() == [len(t) for t in tokens]
        k = [rng.randint(0, len(t)) for t in tokens]
        end = units.after(np.array(k))
        assert (end - units.begin).tolist() == [len("".join(t[:x]).encode()) for t, x in zip(tokens, k, strict=True)]
        assert units.code_points(units.begin, end).tolist() == [len("".join(t[:x])) for t, x in zip(tokens, k, strict=True)]


# ------------------------------------------------------------------------------------------ SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp.MODEL))


def test_sentence_pieces(spark, docs, texts, library):
    got = sp.encode_and_decode(docs).collect()
    ids = [None if i % 17 == 16 else i for i in range(len(texts))]
    want = Counter()
    for i, t in [*zip(ids, texts, strict=True), (3, texts[3])]:
        x = library.encode(t or "")
        want[i, tuple(x), library.decode(x)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert sp.encode_and_decode(spark.createDataFrame([], DOCS)).count() == 0


def test_pieces_equal_the_library(library):
    import public_tokenizers

    pieces = sp.Pieces(public_tokenizers.path(sp.MODEL), parts=50, pairs=50)  # a memory that is often full
    rng = random.Random(7)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    makers = [
        lambda: "".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))),
        lambda: " " * rng.randint(0, 70) + "the " + " " * rng.randint(0, 70) + rng.choice("a\n"),
        lambda: "".join(rng.choice("aeinrst ") for _ in range(rng.randint(0, 90))),
        lambda: "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(rng.randint(0, 30))),
        lambda: "".join(rng.choice(["\r", "\n", ";", "}", " ", "  ", "=", "-", "*", "0", "▁", "e", "\x00", "<0x0A>", "<s>"]) for _ in range(rng.randint(0, 40))),
    ]
    for k in range(3000):
        t = makers[k % len(makers)]()
        want = library.encode(t)
        assert pieces.encode(t).tolist() == want, t
        assert pieces.decode(want) == library.decode(want), t
        some = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 31999), 259, 28705]) for _ in range(rng.randint(0, 6))]
        assert pieces.decode(some) == library.decode(some), some


def test_backtracking_is_used(library):
    """Greedy longest matches are wrong for some of these, so that places fail and are left again."""
    import public_tokenizers

    pieces = sp.Pieces(public_tokenizers.path(sp.MODEL))
    rng = random.Random(8)
    greedy_wrong = 0
    for _ in range(2000):
        t = "".join(rng.choice("aeionrstlh") for _ in range(30))
        ids, at = [], 0
        s = "▁" + t
        while at < len(s):
            n = next(n for n in range(len(s) - at, 0, -1) if s[at : at + n] in pieces.id)
            ids.append(pieces.id[s[at : at + n]])
            at += n
        want = library.encode(t)
        greedy_wrong += ids != want
        assert pieces.encode(t).tolist() == want
    assert greedy_wrong > 1000


# ------------------------------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, x string, a string, slot string, shard string, id string"


def expected(rows, every=50, positives=5, k=3):
    usable = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        usable.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) if math.isfinite(256 * c) else int(math.copysign(1.7976931348623157e308, c)) for c in v]))
    clamp = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = Counter()
    for i, y, v in {(i, y, tuple(v)) for i, y, v in usable if i % every == 0}:
        score = [(clamp(sum(p * q for p, q in zip(v, w, strict=True))), j, z) for j, z, w in usable if len(w) == len(v) and j != i]
        best = sorted((-s, j) for s, j, z in score if z == y)[:positives]
        negatives = sorted((-s, j) for s, j, z in score if z != y)
        for p, j in best:
            inside = [(-s, n) for s, n in negatives if 50 * -p <= 100 * -s <= 95 * -p][:k]
            for rank, (s, n) in enumerate(inside, 1):
                out[i, j, rank, n, -p, s] += 1
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "a", "s", "h", "i") for i, v, y in rows], VECTORS).repartition(3)


def mined(spark, rows, **how):
    return Counter(tuple(r) for r in hn.mine(table_of(spark, rows), **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 6)) + 1.5
    x[100:220] = x[100]  # a large group of equal vectors, so that scores tie
    x[300:340] *= -1
    rows = [(i, x[i].tolist(), int(i % 4)) for i in range(700)]
    rows += [(None, x[0].tolist(), 1), (900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (902, [float("nan")] * 6, 2), (903, [float("inf")] * 6, 2), (904, x[4].tolist(), None)]
    rows += [(950, [0.5, 0.25], 1), (951, [0.5, 0.5], 1), (952, [0.5, 0.125], 2), (1000, [], 1), (1001, [], 1), (1002, [], 3), (1050, [0.0] * 6, 0)]
    rows += [rows[50], rows[50], rows[51], (100, x[7].tolist(), 3)]  # repeated rows, and an id with two vectors
    want = expected(rows)
    assert len(want) > 100 and len({k[0] for k in want}) > 8
    assert mined(spark, rows) == want
    assert mined(spark, rows, shard_rows=11) == want
    assert mined(spark, [r for r in rows if r[0] is None]) == Counter() == mined(spark, [])


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(7)
    x = np.abs(rng.standard_normal((120, 3))) * 10.0 ** rng.integers(0, 9, (120, 1))
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(120)]
    rows += [(200, [1e308, 1.0, 1.0], 0), (201, [1e308, -1.0, 1.0], 0), (202, [-1e308, 1.0, 1.0], 1), (203, [2.0, 1.0, 1.0], 1)]
    assert mined(spark, rows) == expected(rows)


def test_few_positives_and_empty_windows(spark):
    rows = [(0, [1.0], 5), (1, [1.0], 6), (2, [0.9], 6), (3, [0.5], 1), (4, [0.4], 1), (50, [1.0], 8), (100, [-1.0], 3), (101, [1.0], 3), (102, [0.5], 3)]
    assert mined(spark, rows) == expected(rows)


def test_best_of_chunks():
    """Fed in chunks, the best of each slot are those of all scores."""
    rng = np.random.default_rng(3)
    scores = rng.integers(-20, 60, (7, 500))
    allowed = rng.random((7, 500)) < 0.8
    tops = np.sort(rng.integers(0, 60, (7, 4)), axis=1)[:, ::-1]
    floor = rng.integers(-30, 10, 7)
    best = hn.Best(tops, floor, 3)
    for a in range(0, 500, 70):
        best.feed(scores[:, a : a + 70], allowed[:, a : a + 70], a)
    for i in range(7):
        for j in range(4):
            below = max(tops[i, j + 1] if j < 3 else -(1 << 62), floor[i])
            want = sorted((-s, p) for p, s in enumerate(scores[i].tolist()) if allowed[i, p] and below < s <= tops[i, j])[:3]
            assert [(-s, p) for s, p in zip(best.score[i, j].tolist(), best.place[i, j].tolist(), strict=True) if p >= 0] == want
