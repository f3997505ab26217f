"""Temperature mixing of sources, with DataFrame operations only.

A source's weight is its share of all tokens to the power ``alpha``, normalised. The exponent is bisected: the smallest one
for which no source is repeated more than ``repeats`` times while the largest source is used once, or the one whose weights have a
given entropy (a share of the largest possible). The budget of tokens follows: what lets the most used source be used just once,
so that no document is left out, unless a budget is given.

The weights are realised by block permutations. A source's documents are dealt into blocks by hash, a block of about
``block_tokens`` tokens; every pass over a source (an epoch) takes its blocks in an order of its own. Whole blocks are taken while
the source's quota lasts; of the block on the border, documents are taken in order until the quota is reached. Nothing larger than
a block is ever ordered in one task, so a source with most of the documents is like any other.

Tokens are the words of a text, at least one for each document. Defined results: a null source is a source of its own. A null or
empty text counts one token, a text of any length all of its words. Repeated rows are drawn each for itself. Other columns, whatever their
names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullscan.llm.common import table_written

BLOCK_TOKENS = 2_000_000


def weights(tokens: dict, alpha: float) -> dict:
    top = max(tokens.values())
    raw = {s: (t / top) ** alpha for s, t in tokens.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def repetition(tokens: dict, alpha: float) -> float:
    """How often the most repeated source is read while the least repeated is read once."""
    use = [w / tokens[s] for s, w in weights(tokens, alpha).items()]
    return max(use) / min(use)


def entropy_share(tokens: dict, alpha: float) -> float:
    w = [x for x in weights(tokens, alpha).values() if x > 0]
    return -sum(x * math.log(x) for x in w) / math.log(len(tokens)) if len(tokens) > 1 else 1.0


def find_exponent(tokens: dict, repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1] by bisection. Both measures fall as it grows; beyond their reach it is 0 or 1."""
    if not tokens:
        return 1.0
    fits = (lambda a: repetition(tokens, a) <= repeats) if entropy is None else (lambda a: entropy_share(tokens, a) <= entropy)
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def quotas(tokens: dict, alpha: float, budget: int | None = None) -> dict:
    """Tokens to draw from each source. Without a budget, the most used source is drawn exactly once and others more often."""
    w = weights(tokens, alpha)
    total = budget if budget is not None else max(t / w[s] for s, t in tokens.items())
    return {s: t if budget is None and abs(total * w[s] - t) < 1 else math.ceil(total * w[s] - 1e-6) for s, t in tokens.items()}


def mix_sources(docs: DataFrame, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 10) -> DataFrame:
    """One row per drawn document: ``doc_id, source, tokens, epoch, block, position``, and the row's ``row_id``.

    ``position`` orders the mixture: it runs from 0 to 1 through every source's quota, so any stretch has the wanted weights.
    ``epoch`` counts the passes over the source from 0.
    """
    return draw(table_written(counted(docs, F.monotonically_increasing_id()), "mixing"), repeats, entropy, budget, block_tokens, seed)


def counted(docs: DataFrame, row_id: Column) -> DataFrame:
    """Each row's tokens, and a ``row_id`` that parts repeated rows."""
    words = F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^ \t-\r]+"))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("tokens"), row_id.alias("row_id"))


def draw(rows: DataFrame, repeats: float | None, entropy: float | None, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    # One row per source comes to the driver; sources are a fixed, small set of names.
    held = {r.source: r.t for r in rows.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    alpha = find_exponent(held, repeats, entropy)
    quota = quotas(held, alpha, budget) if held else {}
    plan = [(s, t, quota[s], max(1, math.ceil(t / block_tokens)), math.ceil(quota[s] / t)) for s, t in held.items() if quota[s] > 0]
    sources = spark.createDataFrame(plan, "source string, held long, quota long, blocks long, passes int")
    # However often a small source is read, its passes are counted out by the tasks.
    epochs = sources.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).drop("passes")

    first = sources.select(F.col("source").alias("s_"), F.col("blocks").alias("b_"))
    dealt = rows.join(F.broadcast(first), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")  # a row per source
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_id", F.lit(seed)), F.col("b_"))).drop("b_")
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    named = epochs.withColumnRenamed("source", "s_")
    blocks = blocks.join(named, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "block", "epoch", F.lit(seed)), "block")
    begin = F.col("epoch") * F.col("held") + F.sum("t").over(order) - F.col("t")
    blocks = blocks.withColumn("begin", begin).where(F.col("begin") < F.col("quota"))
    taken = blocks.select(F.col("source").alias("s_"), F.col("block").alias("b_"), "epoch", "begin", "t", "quota")

    drawn = dealt.join(taken, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_"))).drop("s_", "b_")
    inner = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("doc_id", "row_id", "epoch", F.lit(seed)), "row_id")
    at = F.col("begin") + F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    drawn = drawn.withColumn("at", at).where(F.col("at") < F.col("quota"))
    return drawn.select("doc_id", "source", "tokens", "epoch", "block", (F.col("at") / F.col("quota")).alias("position"), "row_id")


def mixed_documents(docs: DataFrame, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 10) -> DataFrame:
    """The documents themselves as drawn, all their columns, a row for each draw, in the order of the mixture.

    Draws are joined back by the row's own number, so the texts are read from where they are written once. Each partition is one
    stretch of positions in order, so files written of them have the wanted weights all along, and the passes over a document lie apart.
    """
    kept = table_written(docs.withColumn("__row", F.monotonically_increasing_id()), "mixing")
    rows = table_written(counted(kept, F.col("__row")), "mixing")
    # Written, as placing the ranges reads the draws once more.
    drawn = table_written(draw(rows, repeats, entropy, budget, block_tokens, seed).select(F.col("row_id").alias("__drawn"), F.col("position").alias("__position")), "mixing")
    joined = kept.join(drawn, F.col("__row") == F.col("__drawn"))
    return joined.repartitionByRange("__position").sortWithinPartitions("__position", "__row").select(*docs.columns)
