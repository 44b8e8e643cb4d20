"""Queries of queries.py whose alignments, tree sets and placements grow with the vectors, which are not summed up here; each beside its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import _SQL, query
from ..functions.models import gtr, jukes_cantor
from ..operators import alignment, likelihood, parsimony, splits, statistics
from ..sources import trees
from . import derived as d
from . import queries as q


def _over_all(name: str, n: int) -> str:
    """The SQL of a query with the derivations from single vectors in place of those from n sums."""
    sql = _SQL[name]
    for ambiguous in (False, True):
        sql = sql.replace(d.cells_sql(n, ambiguous), d.all_cells_sql(n, ambiguous))
    return sql.replace(d.values_sql(n), d.all_values_sql(n))


# --- alignments


@query(_over_all("alignment_cells", 24))
def alignment_cells_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.all_cells(spark, sf_dir, 24)


@query(_over_all("site_patterns", 4))
def site_patterns_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.patterns(d.all_cells(spark, sf_dir, 4))


@query(_over_all("weighted_partition_patterns", 3))
def weighted_partition_patterns_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.all_cells(spark, sf_dir, 3)
    site = c.select("site").distinct()
    parts = site.select("site", (F.col("site") % 4).cast("int").alias("part_id"))
    return alignment.patterns(c, site.select("site", (1 + F.col("site") % 5).alias("weight")), parts)


@query(_over_all("informative_sites", 8))
def informative_sites_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.informative(d.all_cells(spark, sf_dir, 8, True))


@query(_over_all("invariant_sites", 3))
def invariant_sites_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.invariant(d.all_cells(spark, sf_dir, 3, True))


@query(_over_all("excluded_sites", 6))
def excluded_sites_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(3, 9), (7, 20), (40, 40)], "lo int, hi int")
    return alignment.exclude(d.all_cells(spark, sf_dir, 6), ranges)


@query(_over_all("partition_presence", 24))
def partition_presence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.all_cells(spark, sf_dir, 24, True)
    parts = c.select("site").distinct().select("site", (F.col("site") % 3).cast("int").alias("part_id"))
    return alignment.presence(c, parts)


@query(_over_all("base_frequencies", 24))
def base_frequencies_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.base_frequencies(d.all_cells(spark, sf_dir, 24, True)).select("state", F.round("freq", 9).alias("freq"))


# --- parsimony and likelihood


@query(_over_all("fitch_score", 4))
def fitch_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsimony.score(q._coded_patterns(d.all_cells(spark, sf_dir, 4)), ((1, 2), (3, 4)))


@query(_over_all("tree_parsimony_scores", 4))
def tree_parsimony_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = {1: (4, 4, 5, 5, 6, 6, -1), 2: (4, 5, 4, 5, 6, 6, -1), 3: (4, 5, 5, 4, 6, 6, -1)}
    some = spark.createDataFrame([(k, list(v)) for k, v in shapes.items()], "tree_id int, parents array<int>")
    return parsimony.tree_scores(q._coded_patterns(d.all_cells(spark, sf_dir, 4)), some)


#: An undetermined code of a short last block has all four bits.
_MOVE = re.compile(r"\(case when \(\((c\d) >> (\d)\) & 1\) = 1 then ([\d.e-]+)::double else ([\d.e-]+)::double end\)")


def _for_any_code(sql: str) -> str:
    return _MOVE.sub(r"(\4::double * bit_count(\1) + (\3::double - \4::double) * ((\1 >> \2) & 1))", sql)


@query(_for_any_code(_over_all("jukes_cantor_sites", 4)))
def jukes_cantor_sites_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = q._coded_patterns(d.all_cells(spark, sf_dir, 4))
    site = likelihood.jukes_cantor_site([F.element_at("codes", k) for k in (1, 2, 3, 4)], [0.1] * 5)
    return p.select("weight", F.round(F.log(site), 9).alias("ll"), "pattern")


@query(_for_any_code(_over_all("tree_likelihood", 4)).replace("round(sum(weight * ll), 6)", "round(sum(weight * ll), 3)"))
def tree_likelihood_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = q._coded_patterns(d.all_cells(spark, sf_dir, 4)).withColumn("pattern_id", F.xxhash64("pattern"))
    one = spark.createDataFrame([(1, "(1:0.1,2:0.1,(3:0.1,4:0.1):0.1);")], "tree_id long, newick string")
    ll = likelihood.site_likelihoods(p, one, list("1234"), jukes_cantor())
    return statistics.tree_likelihoods(ll).select(F.round("lnl", 3).alias("lnl"))


@query(_over_all("pair_distances", 12).replace("), n as (", " where bit_count(code) = 1), n as (", 1))
def pair_distances_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.pair_distances(d.all_cells(spark, sf_dir, 12)).withColumn("distance", F.round("distance", 9))


@query(_over_all("quartet_scores", 7))
def quartet_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.quartet_scores(q._coded_patterns(d.all_cells(spark, sf_dir, 7)), 7)


@query()
def gamma_tree_evaluation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5**4 distinct columns of four taxa, whatever the number of sites."""
    some = spark.createDataFrame([(1, "(1,2,(3,4));"), (2, "(1,3,(2,4));"), (3, "(1,4,(2,3));")], "tree_id long, newick string")
    model = gtr([1, 2, 1, 1, 2, 1], [0.3, 0.2, 0.2, 0.3], 0.7)
    return likelihood.evaluate_trees(q._coded_patterns(d.all_cells(spark, sf_dir, 4)), some, list("1234"), model).select("tree_id", F.round("lnl", 3).alias("lnl"))


@query()
def quartet_likelihoods_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.quartet_likelihoods(q._coded_patterns(d.all_cells(spark, sf_dir, 5)), 5, jukes_cantor())


# --- tree sets: the number of trees grows with the vectors


def _n_trees(s: DataFrame) -> int:
    return s.select("tree_id").distinct().count()


@query(_over_all("split_frequencies", 5))
def split_frequencies_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.frequencies(d.all_splits(spark, sf_dir, 5))


@query(_over_all("split_support", 5).replace("c.n / 8", "c.n / (select count(distinct tree_id) from s)"))
def split_support_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of the splits of tree 0 in all trees."""
    s = d.all_splits(spark, sf_dir, 5)
    return splits.support(s.where("tree_id = 0").select("split_key"), s, _n_trees(s))


@query(_over_all("majority_consensus", 4).replace("count(*) > 4", f"count(*) > (select count(distinct tree_id) from ({d.all_splits_sql(4)})) // 2"))
def majority_consensus_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.all_splits(spark, sf_dir, 4)
    return splits.consensus(s, _n_trees(s))


@query(_over_all("split_conflicts", 5))
def split_conflicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.all_splits(spark, sf_dir, 5)
    return splits.conflicts(s.where("tree_id = 0"), splits.frequencies(s))


@query(_over_all("rogue_gains", 6).replace("count(*) > 4", "count(*) > (select count(distinct tree_id) from s) // 2"))
def rogue_gains_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.all_splits(spark, sf_dir, 6)
    return splits.rogue_gains(s, _n_trees(s), 6)


# --- statistics: every vector is a tree or a query


@query(_over_all("likelihood_test", 5))
def likelihood_test_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = statistics.likelihood_test(d.all_site_ll(spark, sf_dir, 5), 1)
    return t.withColumn("diff", F.round("diff", 6)).withColumn("sd", F.round("sd", 6))


def _by_vector(name: str, n: int) -> str:
    """The SQL of a query with one tree or query for each vector, in place of n sums."""
    every = """select vec_id + 1 as tree_id, site as pattern_id, cast(site % 3 + 1 as bigint) as weight, -1.0 - abs(v) as ll
  from (select vec_id, generate_subscripts(embedding, 1) as site, cast(unnest(embedding) as double) as v from embeddings)"""
    return _SQL[name].replace(d.site_ll_sql(n), every).replace("cast(tree_id as int)", "tree_id")


def _ll_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("tree_id"), F.posexplode("embedding").alias("p", "x"))
    site = F.col("p") + 1
    return e.select("tree_id", site.alias("pattern_id"), (site % 3 + 1).cast("long").alias("weight"), (-1.0 - F.abs(F.col("x").cast("double"))).alias("ll"))


@query(_by_vector("significance_counts", 20))
def significance_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.not_above(_ll_by_vector(spark, sf_dir), 1)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll = _ll_by_vector(spark, sf_dir)
    return ll.select(F.col("tree_id").alias("query_id"), F.col("pattern_id").alias("edge"), (40 * F.col("ll")).alias("lnl"))


@query(_by_vector("placement_weights", 50))
def placement_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.placement_weights(_placed(spark, sf_dir)).withColumn("lwr", F.round("lwr", 6))


@query(_by_vector("accumulated_placements", 50))
def accumulated_placements_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.accumulated_placements(_placed(spark, sf_dir)).withColumn("lwr", F.round("lwr", 6))


@query(_by_vector("placement_entropy", 50))
def placement_entropy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.placement_entropy(_placed(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@query(_by_vector("heuristic_edges", 50))
def heuristic_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_edges(_placed(spark, sf_dir), 64, 0.1)


# --- trees from text


@query(_SQL["newick_splits"])
def newick_splits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of five taxa for each order, written and read back."""
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 3
    inner = F.when(k == 0, "((b,c),d)").when(k == 1, "((b:0.5,d)x:0.1,c)").otherwise("((c,'d'),b[note])")
    newick = F.concat(F.lit("(a,"), inner, F.lit(",e);"))
    found = trees.splits(o.select(F.col("o_orderkey").cast("int").alias("tree_id"), newick.alias("newick")), {n: i + 1 for i, n in enumerate("abcde")})
    return found.select("tree_id", "split_key")
