"""Resampling and statistics of site likelihoods: bootstraps, likelihood tests, weights of trees and placements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng


def bootstrap_weights(n_sites: int, replicates: DataFrame, seed: int) -> DataFrame:
    """replicates: (replicate), from 0. (replicate, site, weight): each replicate draws n_sites sites with replacement. Draws are numbered
    through all replicates, so that every task computes its own; the same stream as one after the other."""
    draws = replicates.select("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_sites))).alias("d"))
    k = F.col("replicate").cast("long") * n_sites + F.col("d")
    drawn = draws.select("replicate", (F.floor(rng.uniform(seed, k) * n_sites) + 1).cast("int").alias("site"))
    return drawn.groupBy("replicate", "site").agg(F.count(F.lit(1)).alias("weight"))


def tree_likelihoods(site_ll: DataFrame) -> DataFrame:
    """(tree_id, lnl): weighted sums of (tree_id, pattern_id, weight, ll)."""
    return site_ll.groupBy("tree_id").agg(F.sum(F.col("weight") * F.col("ll")).alias("lnl"))


def likelihood_test(site_ll: DataFrame, best: int) -> DataFrame:
    """(tree_id, diff, sd, at_5, at_2, at_1): each tree's log likelihood below that of tree `best`, its standard deviation over
    sites, and whether it is significantly worse at 5, 2 and 1 percent (normal quantiles)."""
    ref = site_ll.where(F.col("tree_id") == best).select("pattern_id", F.col("ll").alias("ref"))
    d = site_ll.join(ref, "pattern_id").withColumn("d", F.col("ref") - F.col("ll"))
    sums = d.groupBy("tree_id").agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("d")).alias("s"), F.sum(F.col("weight") * F.col("d") * F.col("d")).alias("q")
    )
    sd = F.sqrt(F.col("w") * (F.col("q") - F.col("s") * F.col("s") / F.col("w")) / (F.col("w") - 1))
    out = sums.select("tree_id", F.col("s").alias("diff"), sd.alias("sd"))
    # Two-sided normal quantiles at 5, 2 and 1 percent.
    worse = lambda z: F.col("diff") > z * F.col("sd")
    return out.select("*", worse(1.95996).alias("at_5"), worse(2.326).alias("at_2"), worse(2.57583).alias("at_1"))


def expected_weights(site_ll: DataFrame, weights: DataFrame) -> DataFrame:
    """(tree_id, elw, cumulative): the mean over bootstrap replicates (replicate, pattern_id, weight) of each tree's share of likelihood,
    and the running sum by falling share. Trees and replicates, not sites, are what windows run over."""
    w = weights.select("replicate", F.col("pattern_id").alias("p"), F.col("weight").alias("times"))
    lnl = site_ll.join(w, F.col("pattern_id") == F.col("p")).groupBy("replicate", "tree_id").agg(F.sum(F.col("times") * F.col("ll")).alias("lnl"))
    rep = Window.partitionBy("replicate")
    e = lnl.withColumn("e", F.exp(F.col("lnl") - F.max("lnl").over(rep)))
    share = e.withColumn("share", F.col("e") / F.sum("e").over(rep)).groupBy("tree_id").agg(F.avg("share").alias("elw"))
    order = Window.orderBy(F.desc("elw"), "tree_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return share.select("tree_id", "elw", F.sum("elw").over(order).alias("cumulative"))


def best_by_replicate(site_ll: DataFrame, weights: DataFrame) -> DataFrame:
    """(tree_id, wins): in how many bootstrap replicates each tree has the highest likelihood, ties to the smaller tree_id."""
    w = weights.select("replicate", F.col("pattern_id").alias("p"), F.col("weight").alias("times"))
    lnl = site_ll.join(w, F.col("pattern_id") == F.col("p")).groupBy("replicate", "tree_id").agg(F.sum(F.col("times") * F.col("ll")).alias("lnl"))
    top = lnl.groupBy("replicate").agg(F.max(F.struct("lnl", (-F.col("tree_id")).alias("neg"))).alias("t"))
    return top.groupBy((-F.col("t.neg")).alias("tree_id")).agg(F.count(F.lit(1)).alias("wins"))


def window_bias(site_ll: DataFrame, width: int) -> DataFrame:
    """site_ll: (branch, site, ll). (site, branch, ll): for each full window of sites from `site` on the branch of the largest sum, ties to
    the smaller branch. Running sums partition by branch."""
    ahead = Window.partitionBy("branch").orderBy("site").rowsBetween(Window.currentRow, width - 1)
    sums = site_ll.select("branch", "site", F.sum("ll").over(ahead).alias("s"), F.count(F.lit(1)).over(ahead).alias("n")).where(F.col("n") == width)
    top = sums.groupBy("site").agg(F.max(F.struct("s", (-F.col("branch")).alias("neg"))).alias("t"))
    return top.select("site", (-F.col("t.neg")).alias("branch"), F.col("t.s").alias("ll"))


def not_above(site_ll: DataFrame, reference: int) -> DataFrame:
    """(pattern_id, n): how many other trees have at most the reference tree's likelihood at each pattern."""
    ref = site_ll.where(F.col("tree_id") == reference).select("pattern_id", F.col("ll").alias("ref"))
    other = site_ll.where(F.col("tree_id") != reference).join(ref, "pattern_id")
    return other.groupBy("pattern_id").agg(F.count_if(F.col("ll") <= F.col("ref")).alias("n"))


def placement_weights(placements: DataFrame, most: int = 7, least: float = 0.01) -> DataFrame:
    """placements: (query_id, edge, lnl). (query_id, rank, edge, lwr): each query's edges by likelihood, at most `most` of them, with at least
    `least` of the best one's weight; lwr is the weight among all edges. Ties go to the smaller edge."""
    q = Window.partitionBy("query_id")
    p = placements.withColumn("e", F.exp(F.col("lnl") - F.max("lnl").over(q)))
    p = p.withColumn("lwr", F.col("e") / F.sum("e").over(q)).withColumn("rank", F.row_number().over(q.orderBy(F.desc("lnl"), "edge")))
    return p.where((F.col("rank") <= most) & (F.col("e") >= least)).select("query_id", "rank", "edge", "lwr")


def accumulated_placements(placements: DataFrame, upto: float = 0.95) -> DataFrame:
    """As placement_weights, but edges until their weights reach `upto`, the one that crosses it included."""
    q = Window.partitionBy("query_id")
    p = placements.withColumn("e", F.exp(F.col("lnl") - F.max("lnl").over(q))).withColumn("lwr", F.col("e") / F.sum("e").over(q))
    order = q.orderBy(F.desc("lnl"), "edge")
    p = p.withColumn("rank", F.row_number().over(order)).withColumn("run", F.sum("lwr").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return p.where(F.col("run") - F.col("lwr") <= upto).select("query_id", "rank", "edge", "lwr")


def placement_entropy(placements: DataFrame) -> DataFrame:
    """(query_id, entropy): of the edges' weights, from 0 to 1."""
    q = Window.partitionBy("query_id")
    p = placements.withColumn("e", F.exp(F.col("lnl") - F.max("lnl").over(q))).withColumn("p", F.col("e") / F.sum("e").over(q))
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    n = F.count(F.lit(1))
    return p.groupBy("query_id").agg(F.when(n > 1, h / F.log(n)).otherwise(0.0).alias("entropy"))


def top_edges(placements: DataFrame, n_edges: int, share: float) -> DataFrame:
    """(query_id, edge): the edges that a heuristic keeps: max(5, share of all edges, rounded), by likelihood."""
    keep = max(5, int(0.5 + n_edges * share))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lnl"), "edge"))
    return placements.withColumn("r", rank).where(F.col("r") <= keep).select("query_id", "edge")


def most_parsimonious(scores: DataFrame) -> DataFrame:
    """scores: (query_id, edge, score). (query_id, edge, score): all edges of the least score."""
    best = scores.groupBy("query_id").agg(F.min("score").alias("best"))
    return scores.join(best, "query_id").where("score = best").select("query_id", "edge", "score")


def best_topologies(trees: DataFrame, k: int) -> DataFrame:
    """trees: (tree_id, topology, lnl). (rank, tree_id, topology, lnl): the k best distinct topologies, each by its best tree."""
    best = trees.groupBy("topology").agg(F.max(F.struct("lnl", (-F.col("tree_id")).alias("neg"))).alias("b"))
    top = best.select("topology", F.col("b.lnl").alias("lnl"), (-F.col("b.neg")).alias("tree_id")).orderBy(F.desc("lnl"), "tree_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("lnl"), "tree_id"))  # k rows
    return top.select(rank.alias("rank"), "tree_id", "topology", "lnl")


def information_criteria(fits: DataFrame, n: int) -> DataFrame:
    """fits: (model, lnl, k). Adds aic, aicc (null where n - k - 1 isn't positive) and bic."""
    k, lnl = F.col("k"), F.col("lnl")
    aic = 2 * k - 2 * lnl
    return fits.select("*", aic.alias("aic"), F.when(n - k - 1 > 0, aic + 2.0 * k * (k + 1) / (n - k - 1)).alias("aicc"), (k * math.log(n) - 2 * lnl).alias("bic"))
