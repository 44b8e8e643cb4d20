"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize

#: Lengths that share a block: sums run over the blocks, then within each block.
BLOCK = 256


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents have each number of tokens. Null and empty texts have length 0. Each batch
    counts its own lengths before anything is shuffled."""
    config = bpe._config(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.loaded(config.value)
        for batch in batches:
            counted = pd.Series(list(encoder.counts(batch["text"].tolist())), dtype="int64").value_counts()
            yield pd.DataFrame({"length": counted.index, "n_docs": counted.to_numpy()})

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """A row per length that occurs: length, n_docs, docs_longer, tokens_longer (of documents longer than it),
    docs_total, tokens_total, quantile (share of documents that are not longer), truncated_total (tokens that are left if every
    document is cut at this length).

    Sums over blocks of lengths are added to sums within them, so that no task holds more than a block's lengths or one row a block. An empty histogram
    gives no rows.
    """
    rows = materialize(histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = materialize(
        blocks.select(
            F.col("block").alias("b"),
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
            F.sum("d").over(whole).alias("docs_total"),
            F.sum("t").over(whole).alias("tokens_total"),
        )
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("d_in", F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).withColumn(
        "t_in", F.coalesce(F.sum("tokens").over(longer), F.lit(0))
    )
    out = out.join(blocks, F.col("block") == F.col("b")).select(
        "length", "n_docs", (F.col("d_above") + F.col("d_in")).alias("docs_longer"), (F.col("t_above") + F.col("t_in")).alias("tokens_longer"),
        "docs_total", "tokens_total",
    )
    return out.select(
        "*",
        (1 - F.col("docs_longer") / F.col("docs_total")).alias("quantile"),
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("truncated_total"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_longer, tokens_longer, truncated_total) for any limits: those of the longest length up to the limit hold,
    and documents beyond it count the limit itself."""
    asked = sums.sparkSession.createDataFrame([(x,) for x in limits], "context long")
    upto = sums.join(F.broadcast(asked), F.col("length") <= F.col("context"))
    found = upto.groupBy("context").agg(F.max_by(F.struct("docs_longer", "tokens_longer", "tokens_total"), "length").alias("s"))
    whole = sums.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"))
    s = lambda c, otherwise: F.coalesce(F.col(f"s.{c}"), F.col(otherwise))
    return asked.join(F.broadcast(found), "context", "left").join(F.broadcast(whole)).select(
        "context",
        s("docs_longer", "d").alias("docs_longer"),
        s("tokens_longer", "t").alias("tokens_longer"),
        (F.col("t") - s("tokens_longer", "t") + s("docs_longer", "d") * F.col("context")).alias("truncated_total"),
    )


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """suffix_sums of the documents' length histogram. Documents are encoded whole; repeated rows count as often as
    they occur; other columns are ignored; an empty table gives no rows."""
    return suffix_sums(length_histogram(docs, text_col, path))
