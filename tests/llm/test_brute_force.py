"""Sharding, the quality classifier, mixing and the whole pipeline against plain versions of their own rules."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pullscan.llm import linear, mixing, secrets, sharding, weak_labels

#: Columns that operators use inside, on the documents themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, k string, size string, shard string, root string, block string, epoch string, position string, jid string, raw string, row_id string, kept string, words string, r string, id string"
WORD = re.compile(r"\w+")


def prose(rng, n):
    return " ".join(f"w{rng.integers(0, 4000)}x{'abcdefgh'[rng.integers(0, 8)]}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good, junk and toxic texts, copies and near copies, secrets, nulls, empty and very long texts, repeated rows, a hot source."""
    rng = np.random.default_rng(21)
    texts = []
    for i in range(240):
        t = prose(rng, int(rng.integers(60, 160)))
        if i % 6 == 1:
            t = " ".join(w + "&&&" for w in t.split())
        if i % 6 == 2:
            t += " vilepest gruntslur"
        if i % 10 == 0:
            t = "password=abcdef123456 " + t
        texts.append(t)
    labels = [(i, int(i % 6 != 1), int(i % 6 == 2)) for i in range(240)] + [(None, 1, 0), (5, None, None)]
    near = [" ".join("changed" if j == 40 else w for j, w in enumerate(texts[i].split())) for i in range(0, 60, 3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(300 + i, t) for i, t in enumerate(near)] + [(400 + i, texts[3]) for i in range(30)]
    rows += [(None, texts[9]), (None, prose(rng, 90)), (500, None), (501, ""), (502, " \n "), (None, None), (503, prose(rng, 30_000)), rows[4], rows[4]]
    full = [(i, t, "en", None if (i or 0) % 11 == 10 else "hot" if (i or 0) % 3 else f"s{(i or 0) % 4}", len(t or ""), *"abcdefghijklmn") for i, t in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, CLASHING).repartition(3, "doc_id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.read.parquet(f"{corpus}/documents.parquet")


# ------------------------------------------------------------------------------------------------ sharding


@pytest.mark.parametrize(("shards", "range_rows"), [(24, 500_000), (5, 9), (1, 7)])
def test_shards_one_record_after_another(docs, shards, range_rows):
    """All records in their order, dealt out by a running sum."""
    order = sorted((r.h, r.s, r.doc_id, r.size, r.text_crc32) for r in sharding.sized(docs).collect())
    total = sum(r[3] for r in order)
    want, begin, slots = Counter(), 0, Counter()
    for _, _, i, size, crc in order:
        k = min(shards - 1, (2 * begin + size) * shards // (2 * total))
        want[i, size, crc, k, slots[k]] += 1
        slots[k] += 1
        begin += size
    got = sharding.shard_records(docs, shards=shards, range_rows=range_rows).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}


# -------------------------------------------------------------------------------------- quality classifier


def plain_votes(text, lexicon):
    """What each labeller says, character by character and word by word."""
    words = text.encode().split()
    if not words:
        return {"brevity"}
    n = len(words)
    low = [w for w in (x.strip(b".,;:!?\"'()[]") for x in text.lower().encode().split()) if w]
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text)
    lower = sum("a" <= c <= "z" or "ß" <= c <= "ÿ" and c != "÷" for c in text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    capitals, variety, repeated = upper / max(1, upper + lower), len(set(low)) / n, len(inside) / n
    symbols, shouting, tables = sum(c in "#*$%&|<>" for c in text) / len(text), text.count("!!") / n, text.count(" | ") / n
    toxic = any(w in lexicon for w in low)
    says = {
        "symbols": symbols > 0.02, "capitals": capitals > 0.4, "shouting": shouting > 0.05, "repetition": repeated > 0.5, "monotony": n >= 50 and variety < 0.2, "tables": tables > 0.08,
        "lexicon": toxic, "brevity": n < 3, "prose": variety > 0.35 and repeated < 0.2, "plain": symbols < 0.005 and capitals < 0.2 and tables < 0.02 and shouting < 0.02, "civil": not toxic,
    }
    return {k for k, v in says.items() if v}


def plain_em(patterns, steps=200):
    """Expectation-maximisation over vote patterns, one number at a time."""
    names, faults = weak_labels.LABELLERS, set(weak_labels.FAULTS)
    rate = [{x: 0.15 if x in faults else 0.3 for x in names}, {x: 0.001 if x in faults else 0.7 for x in names}]
    prior = [0.2, 0.8]
    for _ in range(steps):
        post = {}
        for p in patterns:
            logs = [math.log(prior[c]) + sum(math.log(rate[c][x] if x in p else 1 - rate[c][x]) for x in names) for c in (0, 1)]
            top = max(logs)
            e = [math.exp(x - top) for x in logs]
            post[p] = [x / sum(e) for x in e]
        mass = [sum(post[p][c] * n for p, n in patterns.items()) for c in (0, 1)]
        prior = [(m + 1) / (sum(mass) + 2) for m in mass]
        rate = [{x: (sum(post[p][c] * n for p, n in patterns.items() if x in p) + 0.05) / (mass[c] + 0.1) for x in names} for c in (0, 1)]
        for x in faults:
            rate[1][x] = min(rate[1][x], weak_labels.MOST_FALSE)
    return {p: v[1] for p, v in post.items()}


def test_votes_posteriors_and_scores(spark, corpus, docs):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    lexicon, model, scorer = weak_labels.fit(docs, labels)
    assert {b"vilepest", b"gruntslur"} <= lexicon
    texts = [r.text or "" for r in docs.select("text").collect()]
    odd = ["SHOUT!! OUT!! LOUD!!", "a | b | c | d", "x x x x x x", "ÀÉÎ ßé×÷", "### $$$", "one two"]
    for t in texts + odd:
        code = weak_labels.votes(t.encode(), lexicon)
        assert {x for i, x in enumerate(weak_labels.LABELLERS) if code >> i & 1} == plain_votes(t, lexicon), t[:200]
    want = plain_em(Counter(frozenset(plain_votes(t, lexicon)) for t in texts))
    kept, weights = {}, dict(enumerate(scorer.weights.tolist()))
    for r in weak_labels.classify(docs, labels).collect():
        pattern = frozenset(x for i, x in enumerate(weak_labels.LABELLERS) if r.votes >> i & 1)
        assert abs(r.posterior - want[pattern]) < 1e-9
        assert r.kept == (r.score >= 0.5)
        kept.setdefault(r.doc_id, set()).add((r.kept, round(r.score, 9)))
    for r in docs.collect():
        t = r.text or ""
        if not t.strip():
            score = 0.0
        else:
            hit = {int(scorer.place[c]) for part in linear.cells(t.encode()) for c in part.tolist()} - {-1}
            z = scorer.scale * (scorer.bias + math.fsum(weights[i] for i in hit)) + scorer.shift
            score = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        assert any(k == (score >= 0.5) and abs(s - score) < 1e-6 for k, s in kept[r.doc_id])
    left = weak_labels.accepted_documents(docs, labels)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in weak_labels.classify(docs, labels).where("kept").collect())
    nothing = weak_labels.classify(docs.limit(0), labels)
    assert nothing.count() == 0


# ---------------------------------------------------------------------------------------------------- mixing


@pytest.mark.parametrize("how", [{"repeats": 3.0}, {"repeats": None, "entropy": 0.9}, {"repeats": 1.5, "budget": 9000}])
def test_draws_one_after_another(spark, docs, tmp_path, how):
    """Quotas by a scan of exponents, then block after block and document after document until a quota is reached."""
    seed, block_tokens = 10, 700
    mixing.counted(docs, F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    rows = table.collect()
    assert {(r.doc_id, r.tokens) for r in rows} == {(r.doc_id, max(1, len(re.findall(r"[^ \t-\r]+", r.text or "")))) for r in docs.collect()}
    held = Counter()
    for r in rows:
        held[r.source] += r.tokens

    def share(alpha):
        raw = {s: t**alpha for s, t in held.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def fits(alpha):
        w = share(alpha)
        if how.get("entropy"):
            return -sum(x * math.log(x) for x in w.values()) / math.log(len(w)) <= how["entropy"]
        use = [w[s] / held[s] for s in held]
        return max(use) / min(use) <= how["repeats"]

    alpha = next(a / 20000 for a in range(20001) if fits(a / 20000))
    assert abs(alpha - mixing.find_exponent(dict(held), how.get("repeats"), how.get("entropy"))) <= 1 / 20000
    quota = mixing.quotas(dict(held), mixing.find_exponent(dict(held), how.get("repeats"), how.get("entropy")), how.get("budget"))
    total = how.get("budget") or max(t / share(alpha)[s] for s, t in held.items())
    assert all(abs(quota[s] - total * share(alpha)[s]) < 0.01 * total + 1 for s in held)
    # The hash orders are the engine's; everything else is done here.
    blocks = {s: max(1, math.ceil(t / block_tokens)) for s, t in held.items()}
    epochs = max(math.ceil(quota[s] / held[s]) for s in held)
    hashed = table.select("row_id", "source", "tokens", "doc_id", F.xxhash64("doc_id", "row_id", F.lit(seed)).alias("h"), F.array(*(F.xxhash64("doc_id", "row_id", F.lit(e), F.lit(seed)) for e in range(epochs))).alias("o")).collect()
    named = [(s, b, e) for s in held for b in range(blocks[s]) for e in range(epochs)]
    keys = spark.createDataFrame(named, "source string, block long, epoch int").select("source", "block", "epoch", F.xxhash64("source", "block", "epoch", F.lit(seed)).alias("h")).collect()
    rank = {(r.source, r.block, r.epoch): r.h for r in keys}
    inside = defaultdict(list)
    for r in hashed:
        inside[r.source, r.h % blocks[r.source]].append(r)
    want = {}
    for s in held:
        at = 0
        for e in range(math.ceil(quota[s] / held[s])):
            for b in sorted((b for q, b in inside if q == s), key=lambda b: (rank[s, b, e], b)):
                for r in sorted(inside[s, b], key=lambda r: (r.o[e], r.row_id)):
                    if at < quota[s]:
                        want[r.row_id, e] = (r.doc_id, s, r.tokens, b, round(at / quota[s], 12))
                    at += r.tokens
    got = mixing.draw(table, how.get("repeats"), how.get("entropy"), how.get("budget"), block_tokens, seed).collect()
    assert {(r.row_id, r.epoch): (r.doc_id, r.source, r.tokens, r.block, round(r.position, 12)) for r in got} == want and len(got) == len(want)


# -------------------------------------------------------------------------------------------------- pipeline


def groups_of(texts):
    """Classes of texts whose word 5-grams are alike by 0.8 or more, by comparing all pairs."""
    words = [WORD.findall((t or "").lower()) or (t or "").split() for t in texts]
    grams = [set(zip(*(w[k:] for k in range(min(5, len(w)))))) if w else set() for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if words[a] == words[b] or grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                root[find(a)] = find(b)
    out = defaultdict(list)
    for a in range(len(texts)):
        out[find(a)].append(a)
    return list(out.values())


def test_the_pipeline_stage_by_stage(spark, corpus, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    tables, at = [docs], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, corpus)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append(at)
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables]
    # 1: what the scorer accepts.
    assert Counter(i for i, _ in rows[1]) == Counter(r.doc_id for r in weak_labels.classify(docs, labels).where("kept").collect())
    clean = {i for i in range(240) if i % 6 not in (1, 2)}
    assert len(clean & {i for i, _ in rows[1]}) >= 0.97 * len(clean) and not {i for i, _ in rows[1]} & {500, 501, 502}
    # 2: of each class the least id, else one row without an id.
    want = []
    for g in groups_of([t for _, t in rows[1]]):
        ids = [rows[1][a][0] for a in g]
        least = min((i for i in ids if i is not None), default=None)
        want.append(least)
    assert Counter(i for i, _ in rows[2]) == Counter(want) and set(rows[2]) <= set(rows[1])
    # 3: the same rows with each span of the scan replaced, rows without a span as they were.
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(tables[2]).collect() if r.doc_id is not None}
    before = dict(rows[2])
    assert sorted(str(i) for i, _ in rows[3]) == sorted(str(i) for i, _ in rows[2])
    for i, t in rows[3]:
        if i is not None:
            text, places = before[i], sorted((tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s), reverse=True)
            for a, b in places:
                text = text[:a] + secrets.MASK + text[b:]
            assert t == text
    assert all("abcdef123456" not in t for _, t in rows[3]) and any(secrets.MASK in t for _, t in rows[3])
    # 4: every row, as often as its source's quota has it.
    often = Counter(rows[4])
    assert set(often) == set(rows[3]) and max(often.values()) <= 2
    # 5: every id of every row, one after another, in windows without gaps.
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, tables[4], corpus).collect()
    tokens = {k: [*tok.encode(k[1] or "", add_special_tokens=False).ids, 1] for k in often}
    assert sum(r.length for r in pieces) == sum(len(tokens[k]) * n for k, n in often.items())
    first = Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    assert first == Counter({}) + sum((Counter({(k[0], len(tokens[k])): n}) for k, n in often.items()), Counter())
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    assert sorted(by) == list(range(len(by)))
    for s, ps in by.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or s == len(by) - 1
    crc = {(k[0], a, n): zlib.crc32(np.array(t[a : a + n], "<u4").tobytes()) for k, t in tokens.items() for r in pieces if r.doc_id == k[0] and r.doc_tokens == len(t) for a, n in [(r.start, r.length)]}
    assert all(r.ids_crc32 == crc[r.doc_id, r.start, r.length] for r in pieces if r.doc_id is not None)


def test_the_pipeline_without_documents(spark, corpus, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# ----------------------------------------------------------------------------------------------- url filters


def test_thousands_of_listed_hosts(spark):
    """A list from a table, most of it on no page, over pages with many hosts; asked whole and in rounds."""
    from pullscan.llm import url_filter

    rng = np.random.default_rng(31)
    name = lambda i: f"h{i}.d{i % 97}.{'com' if i % 2 else 'org'}"
    hosts = [name(i) for i in range(0, 12_000, 2)] + ["D5.com", "", None]
    listed = spark.createDataFrame([(h,) for h in hosts], "host string")
    urls = [f"http://{'a.b.' * int(rng.integers(0, 2))}{name(int(rng.integers(0, 20_000)))}/p{i}" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    held = {h.lower() for h in hosts if h}

    def blocked(url):
        labels = url[7:].split("/")[0].split(".")
        return any(".".join(labels[k:]) in held for k in range(len(labels)))

    want = {i: "block" if blocked(u) else "allow" for i, u in enumerate(urls)}
    assert 300 < sum(v == "block" for v in want.values()) < 2700
    for keys, limit in ((1_000_000, 1 << 20), (2000, 2048)):
        got = url_filter.filter_urls(pages, (), (), listed, keys, limit).collect()
        assert {r.page_id: r.verdict for r in got} == want
