"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame) -> DataFrame:
    """edges: (u, v). Every v goes to the least of u and u's neighbours. The least are written first, so that the join deals
    out a hub's many edges."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("least"))).select(F.col("u").alias("w"), F.least("u", "least").alias("least"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "least")


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long). Gives (id, component): for every id in a link the least id that links reach from it.

    Large and small stars in turn: edges move to ever smaller ids until each component is a star around its least id,
    after a number of rounds that grows with the logarithm of the number of ids. No task sees more than its share of a hub's edges.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both).where("v > u and v > least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        small = _star(large)
        small = small.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            small.select("u", F.col("least").alias("v"))
        )
        new = materialize(small.distinct())
        # done when every id has one edge and no edge ends where another starts
        if new.groupBy("u").count().where("count > 1").isEmpty() and new.join(
            new.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi"
        ).isEmpty():
            break
        edges = new
    return materialize(
        new.select(F.col("u").alias("id"), F.col("v").alias("component")).union(new.select("v", "v").distinct())
    )
