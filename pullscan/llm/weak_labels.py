"""A quality classifier from weak labels.

Several overlapping labellers vote on every document: those that look for a fault say bad or nothing, those that look for sound prose
say good or nothing. Only how often each pattern of votes occurs leaves the tasks (at most two to the number of labellers, whatever
the corpus). Expectation-maximisation over these patterns estimates how often each labeller speaks on good and on bad documents,
and with that the probability of each pattern to be good. These posteriors are the training labels of a hashed linear scorer,
which judges all documents.

One labeller knows words of toxic texts: those that a bounded labelled sample (``per_class`` rows of each label class, a documented
parameter) shows far more often in toxic than in other texts. The scorer is trained on the texts of the same sample; its labels
are the posteriors, never the given ones.

Defined results: whole texts of any length are judged; an empty table gives no rows; other columns, whatever their names, take no part.
A null or empty text has no word and is rejected. Whole texts of any length are judged, an empty table gives no rows, and
other columns, whatever their names, take no part. A null or repeated ``doc_id`` stays as it is, one row for each row. Without
labelled rows the lexicon is empty and nothing can be trained: ``score`` is then the posterior of the votes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import byte_texts, id_and_text, labelled_sample
from pullscan.llm.linear import Model, plain_words, train
from pullscan.llm.quality_rules import SYMBOLS, repeated_words

#: What looks for faults, then what looks for sound prose.
FAULTS = ("symbols", "capitals", "shouting", "repetition", "monotony", "tables", "lexicon", "brevity")
SOUND = ("prose", "plain", "civil")
LABELLERS = FAULTS + SOUND
#: How often a fault may be found on good documents.
MOST_FALSE = 0.002
SCHEMA = "doc_id long, votes long, posterior double, score double, kept boolean"


def votes(text: bytes, lexicon: frozenset[bytes]) -> int:
    """Which labellers speak, as bits in the order of LABELLERS."""
    words = text.split()
    if not words:
        return 1 << LABELLERS.index("brevity")
    s, n = text.decode(), len(words)
    chars = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    upper = int((((chars >= 65) & (chars <= 90)) | ((chars >= 0xC0) & (chars <= 0xDE) & (chars != 0xD7))).sum())
    lower = int((((chars >= 97) & (chars <= 122)) | ((chars >= 0xDF) & (chars <= 0xFF) & (chars != 0xF7))).sum())
    capitals = upper / max(1, upper + lower)
    plain = plain_words(text)
    variety, repeated = len(set(plain)) / n, repeated_words(words) / n
    symbols = sum(map(s.count, SYMBOLS)) / len(s)
    shouting, tables = s.count("!!") / n, text.count(b" | ") / n
    toxic = any(w in lexicon for w in plain)
    spoken = (
        symbols > 0.02, capitals > 0.4, shouting > 0.05, repeated > 0.5, n >= 50 and variety < 0.2, tables > 0.08, toxic, n < 3,
        variety > 0.35 and repeated < 0.2, symbols < 0.005 and capitals < 0.2 and tables < 0.02 and shouting < 0.02, not toxic,
    )
    return sum(1 << i for i, x in enumerate(spoken) if x)


def toxic_words(rows: list[tuple[bytes, int, int]], most: int = 2000) -> frozenset[bytes]:
    """Words that at least one in a hundred toxic texts of a labelled sample holds (and eight of them), and hardly any other text."""
    toxic, other = Counter(), Counter()
    n1 = n0 = 0
    for text, _, t in rows:
        (toxic if t else other).update(set(plain_words(text)))
        n1, n0 = n1 + (t == 1), n0 + (t == 0)
    odds = {w: c / n1 / ((other[w] + 0.5) / max(1, n0)) for w, c in toxic.items() if c >= max(8, n1 / 100)}
    return frozenset(sorted((w for w, o in odds.items() if o >= 20), key=lambda w: (-odds[w], w))[:most])


class LabelModel:
    """P(good) of each vote pattern, and how often each labeller speaks on bad and good documents, by expectation-maximisation."""

    def __init__(self, patterns: dict[int, int], steps: int = 200) -> None:
        codes = sorted(patterns)
        spoken = (np.array(codes, np.int64).reshape(-1, 1) >> np.arange(len(LABELLERS))) & 1
        n = np.array([patterns[c] for c in codes], float)
        # To start with, faults are found on bad documents and hardly ever on good ones.
        fault = np.arange(len(LABELLERS)) < len(FAULTS)
        rate = np.array([np.where(fault, 0.15, 0.3), np.where(fault, 0.001, 0.7)])
        prior, post = np.array([0.2, 0.8]), np.zeros((len(codes), 2))
        for _ in range(steps if len(codes) else 0):
            logs = np.log(prior) + spoken @ np.log(rate).T + (1 - spoken) @ np.log(1 - rate).T
            post = np.exp(logs - logs.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            mass = post * n[:, None]
            prior = (mass.sum(0) + 1) / (mass.sum() + 2)
            rate = (mass.T @ spoken + 0.05) / (mass.sum(0)[:, None] + 0.1)
            # Faults are found on few good documents at most; without this, a kind of fault of its own could pass for good.
            rate[1, fault] = np.minimum(rate[1, fault], MOST_FALSE)
        self.prior, self.rate = prior, rate
        self.good = {c: float(p[1]) for c, p in zip(codes, post, strict=True)}

    def accuracies(self) -> dict[str, float]:
        """P(a labeller is right | it speaks)."""
        share = self.rate * self.prior[:, None]
        bad = share[0] / share.sum(0)
        return {name: float(bad[i] if name in FAULTS else 1 - bad[i]) for i, name in enumerate(LABELLERS)}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> tuple[frozenset[bytes], LabelModel, Model | None]:
    rows = labelled_sample(docs, labels, per_class, salt=9)
    lexicon = toxic_words(rows)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most 2,000 words

    def patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            seen.update(votes(t, sent.value) for t in byte_texts(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    found = id_and_text(docs).select("text").mapInArrow(patterns, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    model = LabelModel({r.votes: r.n for r in found})
    posterior = np.array([model.good[votes(t, lexicon)] for t, _, _ in rows])
    return lexicon, model, train([r[0] for r in rows], posterior, np.ones(len(rows)))


def judged(texts: list[bytes], lexicon: frozenset[bytes], model: LabelModel, scorer: Model | None) -> tuple[list[int], list[float], list[float]]:
    """Votes, posterior and score of each text; the score of a text without words is 0."""
    codes = [votes(t, lexicon) for t in texts]
    posterior = [model.good.get(c, 0.5) for c in codes]
    score = [0.0 if not t.strip() else p if scorer is None else scorer.probability(t) for t, p in zip(texts, posterior, strict=True)]
    return codes, posterior, score


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.5) -> DataFrame:
    """``doc_id, votes, posterior, score, kept``: what the labellers say, and what the scorer trained on it decides."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # of fixed size

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, posterior, score = judged(byte_texts(b.column("text")), *sent.value)
            kept = [s >= threshold for s in score]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(codes, pa.int64()), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", "votes", "posterior", "score", "kept"])

    return id_and_text(docs).mapInArrow(judge, SCHEMA)


def accepted_documents(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.5) -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns: the whole row passes the scorer, nothing is joined."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    schema = docs.schema

    def accept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = judged(byte_texts(b.column(b.schema.get_field_index("text"))), *sent.value)[2]
            yield b.filter(pa.array([s >= threshold for s in score], pa.bool_()))

    return docs.mapInArrow(accept, schema)
