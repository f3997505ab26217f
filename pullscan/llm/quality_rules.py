"""Quality rules: fixed counting rules, and a calibrated model over hashed word and character n-grams with a fixed threshold.

The model is fitted on a bounded sample of labelled rows (``per_class`` rows of each of the four label classes, a documented
parameter); a labelled row is good if its quality is 1 and it is not toxic. Classes weigh as often as they occur among all
labels. Counting and scoring run over every whole text, one Arrow batch at a time, without a shuffle.

Defined results: whole texts of any length count; an empty table gives no rows; other columns, whatever their names, take no part.
A null text has no words and fails the base rule. Whole texts of any length count. An empty table gives no rows, and other
columns, whatever their names, take no part. A null or repeated ``doc_id`` stays as it is, one row for
each row. Without labels of both classes there is no model, and the base rule alone decides (``probability`` is null).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullscan.llm.common import byte_texts, id_and_text, labelled_sample, window_hashes, word_hashes
from pullscan.llm.linear import Model, train

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    h = window_hashes(word_hashes(words), size)
    if not len(h):
        return 0
    _, at, n = np.unique(h, return_inverse=True, return_counts=True)
    often = n[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(h)] |= often
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    words, s = text.split(), text.decode()
    return len(words), len(s) - sum(map(s.count, SPACES)), sum(map(s.count, SYMBOLS)), duplicate_lines(text), repeated_words(words)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def class_weights(labels: DataFrame) -> dict[tuple[int, int], int]:
    """How many rows each (quality, toxic) has, over all labels."""
    rows = labels.groupBy(F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).count().collect()
    return {(r.q, r.t): r["count"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> Model | None:
    rows = labelled_sample(docs, labels, per_class, salt=5)
    share = class_weights(labels)
    held = {k: sum((q, t) == k for _, q, t in rows) for k in share}
    good = np.array([q == 1 and t == 0 for _, q, t in rows], float)
    weight = np.array([share[q, t] / held[q, t] for _, q, t in rows])
    return train([r[0] for r in rows], good, weight)


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 1200, threshold: float = 0.5) -> DataFrame:
    """The counts, ``base_failed``, the calibrated ``probability`` of a good text, and ``kept``, for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # of fixed size

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = byte_texts(b.column("text"))
            rows = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            failed = [base_fails(int(r[0]), int(r[4])) for r in rows]
            p = [None if model is None else model.probability(t) for t in texts]
            kept = [not f and (x is None or x >= threshold) for f, x in zip(failed, p, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS))), pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    return id_and_text(docs).mapInArrow(judge, SCHEMA)
