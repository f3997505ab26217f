"""Secret scans with character Markov models, with DataFrame operations only.

Three base patterns find assignments, access keys and long hexadecimal strings. Beyond them, every token of letters, digits and
joining marks is scored: the logarithm of its probability under a Markov chain over the characters of random strings,
less that under the chain of ordinary identifiers. The chains are trained from labelled samples: what the base patterns found in all
documents is random, the words of a bounded sample of documents without findings (``train_rows``, a documented parameter) are
ordinary. A token whose ratio reaches the bar of its length and that no base span touches is a span of kind ``markov``. The bar is
``threshold`` per pair of characters from sixteen characters on. Shorter tokens need more, the shorter the more (``least_ratio``), since a few
rare characters say little. No fixed length or kind of character is required.

Positions are in code points, the end exclusive. Work is done per row, without a shuffle of texts.

Defined results: a null or empty text has no spans. A null or repeated ``doc_id`` stays, one row for each row. Without any
finding to train from, nothing is added to the base spans. Texts of any length are scanned whole. An empty table gives no rows. Other
columns, whatever their names, take no part, but for names that begin with two underscores, which must be free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import table_written

#: Kind, pattern, the group that counts, and its least length. Fixed values of the base rule. Runs of a class of characters are
#: maximal, so a least length inside the pattern gives the same matches as dropping short ones afterwards; not so for assignments.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
KINDS = ("assign", "access", "hex", "markov")
JOINED = "[A-Za-z0-9+/_-]"
#: Tokens that teach nothing about ordinary words: long ones with a digit and a letter.
MIXED = r"^(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}$"
WORD = r"[A-Za-z0-9+/_-]{6,}"
MASK = "[secret]"
SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"


def _placed(text: Column, order: int, pattern: str | Column, matches: Column, values: Column, least: int) -> Column:
    """The spans of all matches, from the lengths of the texts between them and of the matches themselves."""
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(between, F.length).alias("gap"), matches.alias("match"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), x["value"].alias("value"))
        fits = F.length(x["value"]) >= least
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.size(matches) > 0, F.aggregate(zipped, start, step, lambda x: x["spans"])).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__base`` (base spans in order) to the rows."""
    rows = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    found = {}
    for kind, pattern, group, _ in BASE:
        found[f"__{kind}"] = F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))
        if group:
            found[f"__{kind}_value"] = F.regexp_extract_all("__t", F.lit(pattern), F.lit(group))
    rows = rows.withColumns(found)
    each = [_placed(F.col("__t"), i, pattern, F.col(f"__{kind}"), F.col(f"__{kind}_value" if group else f"__{kind}"), least) for i, (kind, pattern, group, least) in enumerate(BASE)]
    rows = rows.withColumn("__base", F.sort_array(F.concat(*each)))
    return rows.drop("__t", *found)


def _pairs(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of neighbouring ASCII characters occurs in the ``n`` times each ``token`` does: at most 128 x 128 rows."""
    pairs = tokens.where(F.length("token") > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr("token", i, F.lit(2)))).alias("p"))
    rows = pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()
    return {(ord(r.p[0]), ord(r.p[1])): r.n for r in rows if max(map(ord, r.p)) < 128}


def log_ratios(random: dict[tuple[int, int], int], plain: dict[tuple[int, int], int], size: int = 64) -> list[float]:
    """log P(next | this, random) - log P(next | this, ordinary) at ``this * 128 + next``.

    The random chain has one imagined occurrence of each of ``size`` characters, and a tenth of it is spread evenly, since it must
    also know strings over other alphabets than the sample's. The ordinary chain falls back to how often a character occurs in
    ordinary words at all, so what hardly occurs there stays unlikely after any character.
    """
    out, least, weight = [], 0.1, 4
    ordinary = [sum(c for (_, y), c in plain.items() if y == b) + least for b in range(128)]
    total = sum(plain.values()) + least * size
    for a in range(128):
        n1, n0 = (sum(c for (x, _), c in t.items() if x == a) for t in (random, plain))
        for b in range(128):
            p1 = 0.9 * (random.get((a, b), 0) + 1) / (n1 + size) + 0.1 / size
            p0 = (plain.get((a, b), 0) + weight * ordinary[b] / total) / (n0 + weight)
            out.append(round(math.log(p1 / p0), 4))
    return out


def train(scanned: DataFrame, text: str, train_rows: int, seed: int = 7) -> list[float] | None:
    random = _pairs(scanned.select(F.explode("__base").alias("b")).select(F.col("b.value").alias("token"), F.lit(1).alias("n")))
    if not random:
        return None
    n = scanned.count()
    chance = F.pmod(F.xxhash64("doc_id", F.length(text), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = scanned.where((chance * n < train_rows) & (F.size("__base") == 0)).withColumn("row", F.monotonically_increasing_id())
    words = sample.select("row", F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("token"))
    # What is to be found does not teach what is ordinary: random strings of both cases hardly recur in another document.
    words = words.where(~F.col("token").rlike(MIXED)).groupBy("token").agg(F.count("*").alias("n"), (F.min("row") != F.max("row")).alias("recurs"))
    return log_ratios(random, _pairs(words.where(F.col("recurs") | ~F.col("token").rlike("[a-z][A-Z]"))))


def least_ratio(length: int, threshold: float) -> float:
    """The bar of a token: ``threshold`` for each pair of its characters, from sixteen characters on; below, the sum itself rises the
    shorter the token is."""
    n = max(length - 1, 1)
    return threshold * (n if n >= 15 else 15 * (15 / n) ** 2.5)


def _random(text: Column, ratios: list[float], threshold: float) -> Column:
    """The different tokens of a text whose ratio reaches the bar."""
    # One literal; constant folding turns it into an array.
    held = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    # A token too short for its bar even if all its pairs had the largest ratio cannot reach it.
    top = max(ratios)
    least = next((n for n in range(2, 17) if (n - 1) * top >= least_ratio(n, threshold)), 17)
    bars = F.split(F.lit(",".join(str(least_ratio(n, threshold)) for n in range(17))), ",").cast("array<double>")

    def step(acc: Column, c: Column) -> Column:
        return F.struct(F.ascii(c).alias("at"), (acc["sum"] + F.coalesce(F.get(held, acc["at"] * 128 + F.ascii(c)), F.lit(0.0))).alias("sum"))

    def reaches(token: Column) -> Column:
        start = F.struct(F.lit(-128).alias("at"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.split(token, ""), start, step, lambda x: x["sum"]) >= F.coalesce(F.get(bars, F.length(token)), threshold * (F.length(token) - 1))

    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(f"{JOINED}{{{least},}}"), F.lit(0))), reaches)


def with_markov(rows: DataFrame, text: str, ratios: list[float] | None, threshold: float) -> DataFrame:
    """Adds ``__markov``: the spans of tokens that are random, less those that a base span touches."""
    if ratios is None:
        return rows.withColumn("__markov", F.array().cast(SPAN))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("__random", _random(t, ratios, threshold))
    each = F.array_join(F.transform("__random", lambda v: F.concat(F.lit("\\Q"), v, F.lit("\\E"))), "|")
    rows = rows.withColumn("__pattern", F.concat(F.lit(f"(?<!{JOINED})(?:"), each, F.lit(f")(?!{JOINED})")))
    matches = F.regexp_extract_all(t, F.col("__pattern"), F.lit(0))
    placed = F.when(F.size("__random") > 0, _placed(t, len(BASE), F.col("__pattern"), matches, matches, 0)).otherwise(F.array().cast(SPAN))
    rows = rows.withColumn("__markov", placed)
    free = F.filter("__markov", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.withColumn("__markov", free).drop("__random", "__pattern")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"], x["end"])), ",")


def with_spans(docs: DataFrame, train_rows: int = 2000, threshold: float = 1.0) -> DataFrame:
    """The rows with ``__base`` and ``__all``, their spans in order. The rows are scanned once and written, since both training and
    scoring need what the scan found."""
    scanned = table_written(scan(docs), "secrets")
    ratios = train(scanned, "text", train_rows)
    found = with_markov(scanned, "text", ratios, threshold)
    return found.withColumn("__all", F.sort_array(F.concat("__base", "__markov"))).drop("__markov")


def find_secrets(docs: DataFrame, train_rows: int = 2000, threshold: float = 1.0) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, n_markov, spans`` of each document."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_rows, threshold)

    def number(spans: str, order: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["ord"] == order)).cast("long")

    names = [number("__base", i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)]
    return rows.select("doc_id", *names, F.sha2(written(F.col("__base")), 256).alias("base_sha256"), number("__all", len(BASE)).alias("n_markov"), written(F.col("__all")).alias("spans"))


def masked_documents(docs: DataFrame, train_rows: int = 2000, threshold: float = 1.0) -> DataFrame:
    """The documents with every span replaced by a mask and ``n_chars`` counted anew. Spans that overlap are one."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        apart = (x["start"] >= acc["at"]) & ((F.size(acc["parts"]) == 0) | (x["start"] > acc["at"]) | (acc["at"] == 0))
        parts = F.when(apart, F.concat(acc["parts"], F.array(gap, F.lit(MASK)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1, F.length(text)))

    rows = with_spans(docs, train_rows, threshold)
    hit = F.size("__all") > 0
    rows = rows.withColumn("text", F.when(hit, F.aggregate("__all", start, step, finish)).otherwise(text))
    out = {"n_chars": F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rows.withColumns(out).select(*docs.columns)
