"""The corpus queries by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, exact_dedup, mixing, ngram_join, quality, substring_dedup, token_counts, toxicity


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, labels, embeddings, conversations = map(_table, ("documents", "labels", "embeddings", "conversations"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(embeddings(spark, sf_dir), every=100, k=10)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").unionByName(chat.planted(spark))
    return chat.digests(chat.chat_format(chat.records_of(turns)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), words=3, percent=90)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_check(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup,
            op2_quality,
            op3_nearest,
            op4_token_counts,
            op5_chat_format,
            op6_substring_dedup,
            op7_ngram_join,
            op8_toxicity,
            op9_bpe,
            op10_mixing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op5_chat_format": chat.ORACLE_SQL,
        "op6_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_ngram_join": ngram_join.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
    }
