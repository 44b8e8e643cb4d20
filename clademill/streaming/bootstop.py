"""Tree sets that grow: running split counts of a stream of trees, and when they have settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_counts(splits: DataFrame) -> DataFrame:
    """splits: a stream (tree_id, split_key). (split_key, n_trees, n_even): counts so far, those of trees with even ids apart; write with
    output mode complete or update."""
    return splits.groupBy("split_key").agg(F.count(F.lit(1)).alias("n_trees"), F.sum((F.col("tree_id") % 2 == 0).cast("int")).alias("n_even"))


def settled(counts: DataFrame, least: float = 0.99) -> DataFrame:
    """counts: what split_counts has so far. One row: r between the counts of trees with even and odd ids, and settled."""
    x, y = F.col("n_even"), F.col("n_trees") - F.col("n_even")
    sums = counts.agg(F.max(F.abs(x - y)).alias("gap"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    r = F.when(F.col("gap") == 0, 1.0).when((F.col("vx") == 0) | (F.col("vy") == 0), 0.0).otherwise(F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return sums.select(r.alias("r")).select("r", (F.col("r") >= least).alias("settled"))
