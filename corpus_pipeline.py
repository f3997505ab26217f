"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

A stage is a function of (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of
documents. Null texts count as empty ones; rows without an id pass every stage that does not reject them by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pullscan.llm.common import table, table_written
from pullscan.llm.jaccard_join import without_near_copies
from pullscan.llm.mixing import mixed_documents
from pullscan.llm.packing import pack
from pullscan.llm.secrets import masked_documents
from pullscan.llm.weak_labels import accepted_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on weak labels accepts."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id."""
    return without_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return masked_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("packing", packing),
]

#: Learned models, MinHash and a tokenizer have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table_written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

