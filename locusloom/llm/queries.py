"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import chat, decontam, embdup, htmltext, linededup, lm, mixing, neardup, negatives, resample, sharding, sql, toxicity, warc
from locusloom.llm.common import table

#: Target weights of the registered mixture; names without a weight have 1.
MIX_WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 2.0}, "lang": {"de": 4.0, "es": 8.0}}
SHARD_BYTES = 64 << 20

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), MIX_WEIGHTS, fraction=1.0, max_epochs=3.0, seed=7)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"), min_dedup_bytes=0)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), target=SHARD_BYTES)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_windows(turns.unionByName(chat.control_conversation(spark))))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"), min_chars=10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, min_words=20, seed=2024)


def queries() -> dict[str, Query]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_mixing": op4_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_html_text": op6_html_text,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_sharding": op8_sharding,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_chat_format": op10_chat_format,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_line_dedup": op12_line_dedup,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": sql.WARC,
        "op5_decontamination": sql.DECONTAMINATION,
        "op7_embedding_near_dedup": sql.EMBEDDINGS,
        "op9_minhash_near_dedup": sql.NEAR_DUPLICATES,
        "op10_chat_format": sql.CHAT,
        "op11_hard_negatives": sql.NEGATIVES,
        "op12_line_dedup": sql.LINES,
        "op13_importance_resampling": sql.RESAMPLING,
    }
