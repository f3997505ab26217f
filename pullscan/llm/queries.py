"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan.llm.common import table
from pullscan.llm.fill_in_middle import fill_in_middle, restored
from pullscan.llm.hard_negatives import mine
from pullscan.llm.hash_forest import nearest
from pullscan.llm.jaccard_join import jaccard_classes
from pullscan.llm.mixing import mix_sources
from pullscan.llm.packing import pack
from pullscan.llm.quality_rules import quality_rules
from pullscan.llm.secrets import find_secrets
from pullscan.llm.sentence_pieces import encode_and_decode
from pullscan.llm.sharding import shard_records
from pullscan.llm.substring_dedup import dedup_substrings
from pullscan.llm.url_filter import filter_urls, listed_hosts
from pullscan.llm.weak_labels import classify

BLOCK, ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, BLOCK, ALLOW, listed_hosts(pages, LISTED_LABELS)).select("page_id", "host", "path", "rule", "verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("jid")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("row_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode_and_decode(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = restored(F.col("output"), F.col("form"))
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_packing, op3_jaccard_join, op4_nearest, op5_quality_rules, op6_substring_dedup, op7_secrets, op8_sharding, op9_quality_classifier, op10_mixing, op11_hard_negatives, op12_sentence_pieces, op13_fill_in_middle)
}
