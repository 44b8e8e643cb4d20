"""Exact deduplication in three stages: local, salted by digest, global."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize


def normalized(text: Column) -> Column:
    """The text with every run of ASCII white space turned into one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are identical; of equal texts the smallest id stays. Each map task
    first merges its own copies, then copies merge within (digest, salt), so that a group holding a large share of
    all rows is dealt over `salts` tasks, then the winners of the salts merge by digest. Full texts are grouping keys
    of every stage, so two texts with one digest are never merged; where that happens, the documents find their
    group by digest and text, all others by digest alone.

    Null and empty texts are equal to one another. Rows that repeat an id and its text are all marked kept if that id
    is the smallest. Null ids lose against any id. Other columns of docs are ignored, whatever their names.
    """
    doc = docs.select(F.col(f"`{id_col}`").alias("id"), normalized(F.col(f"`{text_col}`")).alias("body"))
    doc = doc.withColumn("digest", digest(F.col("body")))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    salted = doc.groupBy("digest", salt.alias("salt"), "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    # a digest has one row per text; the text itself is kept only where a digest stands for several
    by_digest = merged.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")
    )
    repeated = materialize(by_digest.where("n > 1"))
    known = doc.select("id", "digest", F.sha2("body", 256).alias("text_sha256"), F.lit(None).cast("string").alias("body"))
    if repeated.where("texts > 1").isEmpty():
        groups = repeated.select(F.col("digest").alias("d"), F.col("keep_id"), F.col("n"))
        joined = known.join(groups, F.col("digest") == F.col("d"), "left")
    else:
        groups = materialize(merged.where("n > 1")).select(F.col("digest").alias("d"), F.col("body").alias("b"), "keep_id", "n")
        joined = doc.withColumn("text_sha256", F.sha2("body", 256)).join(
            groups, (F.col("digest") == F.col("d")) & (F.col("body") == F.col("b")), "left"
        )
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_dedup keeps, with their own columns. Of rows that share an id, those with a dropped text go."""
    found = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    lost = materialize(found.select(F.col(id_col).alias("lost_id"), F.col("text_sha256").alias("lost_sha")).distinct())
    sha = F.sha2(normalized(docs[f"`{text_col}`"]), 256)
    return docs.join(lost, docs[f"`{id_col}`"].eqNullSafe(lost["lost_id"]) & (sha == lost["lost_sha"]), "left_anti")


ORACLE_SQL = """
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256
  from documents
), g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)
"""
