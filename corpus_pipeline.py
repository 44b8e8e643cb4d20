"""A corpus pipeline: STAGES applied one after the other, each to all rows that the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clademill.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from clademill.llm.common import shared_dir, small_batches


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator rejects (score 0.7 or more), learning from this input's labelled rows.

    Null and empty texts are scored like any; rows without an id always stay, as no score can be brought to them; rows that repeat an id
    go together if one of them is rejected. Other columns stay as they are.
    """
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text (white space runs count as a space) the one with the least id stays, with its own columns.
    Null texts count as empty. No rows give no rows."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles (similarity 0.8) join, those with the least id stay; empty and null texts and
    rows without an id stay. No rows give no rows."""
    small_batches(spark)
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that each source's words come near its target; a document of a source whose target is above its size
    comes up to three times. Null sources are one source, the last. No rows give no rows."""
    return mixing.mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document, repeats included: number of tokens, and digests of the ids and of the text decoded from them.
    Null texts count as empty."""
    small_batches(spark)
    return bpe.encode_and_check(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", dedup_stage),
    ("near duplicates", near_stage),
    ("mixing", mix_stage),
    ("bpe", encode_stage),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
