"""Queries on codes, partitions, written trees and topologies, over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import _SQL, query
from ..functions import codes
from ..operators import alignment, likelihood, splits
from ..sources import trees
from . import derived as d
from . import queries as q
from . import whole  # noqa: F401  its SQL

_LETTERS = "case code " + " ".join(f"when {k} then '{c}'" for c, k in (("A", 1), ("C", 2), ("M", 3), ("G", 4), ("R", 5), ("S", 6), ("V", 7), ("T", 8), ("W", 9), ("Y", 10), ("H", 11), ("K", 12), ("D", 13), ("B", 14), ("N", 15))) + " end"


@query(f"select taxon_id, site, {_LETTERS} as letter from ({_SQL['encoded_characters']}) where code > 0")
def decoded_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters brought to codes and back: one letter for each code."""
    return q.encoded_characters(spark, sf_dir).where("code > 0").select("taxon_id", "site", codes.char_of(F.col("code")).alias("letter"))


@query("select o_custkey as taxon_id from orders group by 1 having max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) = 0")
def undetermined_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are taxa, their orders characters; orders that aren't urgent are undetermined."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("taxon_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(15).alias("code"))
    return alignment.undetermined_taxa(o)


@query("""
with p as (select distinct l_orderkey as taxon_id, cast(l_linenumber % 3 as int) as part_id from lineitem where l_returnflag <> 'N')
select taxon_id, min(part_id) as part_id, count(*) as n_parts from p group by 1
""")
def read_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are reads: the partitions in which they have data."""
    present = d.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("taxon_id"), (F.col("l_linenumber") % 3).cast("int").alias("part_id"))
    return alignment.only_partition(present.agg(F.bool_or(F.col("l_returnflag") != "N").alias("has_data")))


@query("""
with r as (select s_suppkey as part_id, cast(s_suppkey % 500 + 1 as bigint) as lo, cast(s_suppkey % 500 + 1 + s_nationkey as bigint) as hi from supplier)
select site, count(*) as n from (select unnest(range(lo, hi + 1, 2)) as site from r) group by 1 having count(*) > 1
""")
def partition_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that partitions, each a range of every second site, share."""
    lo = (F.col("s_suppkey") % 500 + 1).cast("long")
    one = F.struct(lo.alias("lo"), (lo + F.col("s_nationkey")).alias("hi"), F.lit(2).cast("long").alias("stride"))
    return alignment.overlaps(alignment.partition_sites(d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("part_id"), F.array(one).alias("ranges"))))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = d.table(spark, sf_dir, "orders")
    newick = F.format_string("(a:%s,'b c':0.25,(c:1,d:2)x:0.5);", (F.col("o_custkey") % 7 / 4).cast("string"))
    return o.select(F.col("o_orderkey").alias("tree_id"), newick.alias("newick"))


@query("""
select o_orderkey as tree_id, cast(k as int) as node_id, cast(case when k = 0 then null when k < 4 then 0 else 3 end as int) as parent_id,
  ([null, 'a', 'b c', 'x', 'c', 'd'])[k + 1] as name, ([null, o_custkey % 7 / 4.0, 0.25, 0.5, 1, 2])[k + 1]::double as length,
  cast(case k when 0 then 3 when 3 then 2 else 0 end as int) as n_children from orders, range(6) r(k)
""")
def newick_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.nodes(_written(spark, sf_dir))


@query("select o_orderkey as tree_id, o_custkey % 7 / 4.0::double + 3.75 as length from orders")
def tree_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_lengths(trees.nodes(_written(spark, sf_dir)))


@query("select cast(k + 1 as int) as taxon_id, (['a', 'b c', 'c', 'd'])[k + 1] as name from range(4) r(k)")
def taxon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.taxa(_written(spark, sf_dir))


@query(f"""
with i as (select tree_id, split_key & 47 as i from ({d.all_splits_sql(6)}))
select distinct tree_id, case when i & 1 = 1 then 47 - i else i end as split_key from i where bit_count(i) between 2 and 3
""")
def restricted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of trees of six taxa on all but the fifth."""
    return splits.restricted(d.all_splits(spark, sf_dir, 6), 47)


@query(f"""
with t as (select tree_id, md5(string_agg(cast(split_key as varchar), ',' order by split_key)) as topology from ({d.all_splits_sql(5)}) group by 1)
select topology, count(*) as n_trees, min(tree_id) as first_tree from t group by 1
""")
def distinct_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.distinct_topologies(d.all_splits(spark, sf_dir, 5))


@query(f"""
with g(group_id, mask) as (values (1, 6), (2, 24), (3, 7), (4, 25)), s as ({d.all_splits_sql(5)})
select group_id, count(*) as n_trees from g join s on s.split_key = case when mask & 1 = 1 then 31 - mask else mask end group by 1
""")
def monophyletic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([(1, 6), (2, 24), (3, 7), (4, 25)], "group_id int, mask long")
    return splits.monophyletic(d.all_splits(spark, sf_dir, 5), groups, 31)


@query(f"""
select tree_id, bool_and(k & 6 in (0, k, 6) and k & 14 in (0, k, 14)) as admissible from (select tree_id, split_key as k from ({d.all_splits_sql(5)})) group by 1
""")
def admissible_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that fit the constraint (a, (b, c), d) with (b, c) and (b, c, d) as its splits."""
    return splits.admissible(d.all_splits(spark, sf_dir, 5), [6, 14])


@query(f"with r as ({_SQL['bootstop_correlations']}) select count(*) filter (r >= 0.99) as passes, round(avg(r), 6) as mean_r, count(*) filter (r >= 0.99) >= count(*) - round(count(*) / 100.0) and avg(r) >= 0.99 as converged from r")
def bootstop_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.converged(q.bootstop_correlations(spark, sf_dir)).withColumn("mean_r", F.round("mean_r", 6))


@query(f"select site, ll from ({q._COLUMNS.format(cells=d.all_cells_sql(4))}) join ({_SQL['jukes_cantor_sites_all']}) using (pattern)")
def per_site_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log likelihood for each column, from those of the distinct columns."""
    p = q._coded_patterns(d.all_cells(spark, sf_dir, 4))
    ll = p.select("codes", F.round(F.log(likelihood.jukes_cantor_site([F.element_at("codes", k) for k in (1, 2, 3, 4)], [0.1] * 5)), 9).alias("ll"))
    return alignment.columns(d.all_cells(spark, sf_dir, 4)).join(ll, "codes").select("site", "ll")
