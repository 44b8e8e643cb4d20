"""Queries on derived phylogenetic tables, each beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import rng
from ..functions.models import gtr, jukes_cantor
from ..operators import alignment, likelihood, parsimony, splits, statistics
from ..sources import trees
from . import derived as d

# --- alignments


@query(f"select taxon_id, site, code from ({d.cells_sql(24)})")
def alignment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.cells(spark, sf_dir, 24)


@query("""
select cast(p_partkey as int) as taxon_id, cast(k as int) as site,
  cast(case when ch in ('A','a') then 1 when ch in ('C','c') then 2 when ch in ('G','g') then 4 when ch in ('T','U','t','u') then 8
    when ch in ('M','m') then 3 when ch in ('R','r') then 5 when ch in ('W','w') then 9 when ch in ('S','s') then 6 when ch in ('Y','y') then 10
    when ch in ('K','k') then 12 when ch in ('V','v') then 7 when ch in ('H','h') then 11 when ch in ('D','d') then 13 when ch in ('B','b') then 14
    when ch in ('N','O','X','n','o','x','-','?') then 15 else -1 end as int) as code
from (select p_partkey, unnest(range(1, length(p_name) + 1)) as k, p_name from part), lateral (select substr(p_name, k, 1) as ch)
""")
def encoded_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names stand for sequences; characters that aren't nucleotides get -1."""
    part = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("taxon_id"), F.col("p_name").alias("seq"))
    return alignment.cells(part).fillna(-1, ["code"])


_COLUMNS = "select site, string_agg(cast(code as varchar), ',' order by taxon_id) as pattern from ({cells}) group by site"


@query(f"select 0 as part_id, pattern, count(*) as weight from ({_COLUMNS.format(cells=d.cells_sql(4))}) group by pattern")
def site_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.patterns(d.cells(spark, sf_dir, 4))


@query(f"""
with c as ({_COLUMNS.format(cells=d.cells_sql(3))})
select cast(site % 4 as int) as part_id, pattern, cast(sum(1 + site % 5) as bigint) as weight from c group by 1, 2
""")
def weighted_partition_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = spark.range(1, d.SITES + 1).select(F.col("id").cast("int").alias("site"))
    parts = site.select("site", (F.col("site") % 4).cast("int").alias("part_id"))
    return alignment.patterns(d.cells(spark, sf_dir, 3), site.select("site", (1 + F.col("site") % 5).alias("weight")), parts)


@query("""
with w as (select cast(user_id % 10 as int) as part_id, event_type as pattern, count(*) as weight from events group by 1, 2),
s as (select part_id, cast(sum(weight) as bigint) as weight from w group by 1)
select part_id, weight, weight / (select cast(sum(weight) as double) from s) as share from s
""")
def partition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.table(spark, sf_dir, "events")
    p = e.groupBy((F.col("user_id") % 10).cast("int").alias("part_id"), F.col("event_type").alias("pattern")).agg(F.count(F.lit(1)).alias("weight"))
    return alignment.partition_shares(p)


@query(f"""
with n as (select site, code, count(*) as n from ({d.cells_sql(8, True)}) where code < 15 group by 1, 2)
select site, count(*) as n_codes, max(n) as most from n group by site having count(*) >= 2 and max(n) >= 2
""")
def informative_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.informative(d.cells(spark, sf_dir, 8, True))


@query(f"select site, cast(bit_and(code) as int) as mask from ({d.cells_sql(3, True)}) group by site having bit_and(code) > 0")
def invariant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.invariant(d.cells(spark, sf_dir, 3, True))


_D3 = "select cast(o_custkey % 16 + 1 as int) as taxon_id, cast(o_orderkey % 64 + 1 as int) as site, cast(max(case when o_totalprice > 150000 then 2 else 1 end) as int) as code from orders group by 1, 2"


@query(f"""
with c as ({_D3}), bad as (select site from c group by site having max(case when code <> 1 then 1 else 0 end) = 0)
select taxon_id, site, code from c where site not in (select site from bad)
""")
def determined_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites at which some taxon has more than the plain state, which stands for an undetermined one."""
    o = d.table(spark, sf_dir, "orders")
    c = o.groupBy((F.col("o_custkey") % 16 + 1).cast("int").alias("taxon_id"), (F.col("o_orderkey") % 64 + 1).cast("int").alias("site")).agg(
        F.max(F.when(F.col("o_totalprice") > 150000, 2).otherwise(1)).alias("code")
    )
    coded = c.withColumn("code", F.when(F.col("code") == 1, 3).otherwise(F.col("code")))
    kept = alignment.drop_undetermined(coded, "BIN")
    return kept.select("taxon_id", "site", F.when(F.col("code") == 3, 1).otherwise(F.col("code")).alias("code"))


@query("""
with s as (select cast(c_custkey as int) as taxon_id, c_mktsegment || '-' || cast(c_nationkey as varchar) as seq from customer)
select taxon_id, same_as from (select taxon_id, min(taxon_id) over (partition by seq) as same_as from s) where taxon_id > same_as
""")
def duplicate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.table(spark, sf_dir, "customer")
    seq = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return alignment.duplicates(c.select(F.col("c_custkey").cast("int").alias("taxon_id"), seq.alias("seq")))


@query("select p_name as name, count(*) as n from part group by p_name having count(*) > 1")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.repeated_names(d.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query(f"""
with c as ({d.cells_sql(6)}), kept as (select * from c where not (site between 3 and 9 or site between 7 and 20 or site = 40)),
n as (select site, cast(row_number() over (order by site) as int) as new from (select distinct site from kept))
select taxon_id, n.new as site, code from kept join n using (site)
""")
def excluded_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(3, 9), (7, 20), (40, 40)], "lo int, hi int")
    return alignment.exclude(d.cells(spark, sf_dir, 6), ranges)


@query(f"""
select taxon_id, cast(site % 3 as int) as part_id, bool_or(code <> 15) as has_data
from ({d.cells_sql(24, True)}) group by 1, 2
""")
def partition_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.cells(spark, sf_dir, 24, True)
    parts = spark.range(1, d.SITES + 1).select(F.col("id").cast("int").alias("site"), (F.col("id") % 3).cast("int").alias("part_id"))
    return alignment.presence(c, parts)


def _frequencies_sql(rounds: int = 8) -> str:
    sql = f"with n as (select code, count(*) as n from ({d.cells_sql(24, True)}) group by code), f0 as (select 0.25 as a, 0.25 as c, 0.25 as g, 0.25 as t)"
    has = [f"((code >> {s}) & 1)" for s in range(4)]
    for k in range(rounds):
        every = " + ".join(f"{h} * f.{x}" for h, x in zip(has, "acgt", strict=True))
        sums = ", ".join(f"sum(n * {h} * f.{x} / ({every})) as {x}" for h, x in zip(has, "acgt", strict=True))
        sql += f", s{k + 1} as (select {sums} from n, f{k} f), f{k + 1} as (select a / (a + c + g + t) as a, c / (a + c + g + t) as c, g / (a + c + g + t) as g, t / (a + c + g + t) as t from s{k + 1})"
    rows = " union all ".join(f"select {s} as state, round({x}, 9) as freq from f{rounds}" for s, x in enumerate("acgt"))
    return f"{sql} {rows}"


@query(_frequencies_sql())
def base_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.base_frequencies(d.cells(spark, sf_dir, 24, True)).select("state", F.round("freq", 9).alias("freq"))


# --- parsimony and likelihood

_WIDE = "select c1, c2, c3, c4, count(*) as weight from (select site, " + ", ".join(f"max(case when taxon_id = {k} then code end) as c{k}" for k in (1, 2, 3, 4)) + f" from ({d.cells_sql(4)}) group by site) group by 1, 2, 3, 4"


def _coded_patterns(cell: DataFrame) -> DataFrame:
    p = alignment.patterns(cell).select(F.transform(F.split("pattern", ","), lambda c: c.cast("int")).alias("codes"), "weight", "pattern")
    return p


@query(f"""
with p as ({_WIDE}),
a as (select *, case when c1 & c2 <> 0 then c1 & c2 else c1 | c2 end as x, case when c3 & c4 <> 0 then c3 & c4 else c3 | c4 end as y from p)
select cast(sum(weight * ((c1 & c2 = 0)::int + (c3 & c4 = 0)::int + (x & y = 0)::int)) as bigint) as score from a
""")
def fitch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsimony.score(_coded_patterns(d.cells(spark, sf_dir, 4)), ((1, 2), (3, 4)))


@query(f"""
with p as ({_WIDE}), t(tree_id, o) as (values (1, 0), (2, 1), (3, 2)),
m as (select tree_id, weight, c1 as a, case o when 0 then c2 when 1 then c3 else c4 end as b, case o when 0 then c3 else c2 end as c, case o when 2 then c3 else c4 end as e from p, t),
n as (select *, case when a & b <> 0 then a & b else a | b end as x, case when c & e <> 0 then c & e else c | e end as y from m)
select tree_id, cast(sum(weight * ((a & b = 0)::int + (c & e = 0)::int + (x & y = 0)::int)) as bigint) as score from n group by tree_id
""")
def tree_parsimony_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three trees of four taxa."""
    shapes = {1: (4, 4, 5, 5, 6, 6, -1), 2: (4, 5, 4, 5, 6, 6, -1), 3: (4, 5, 5, 4, 6, 6, -1)}
    some = spark.createDataFrame([(k, list(v)) for k, v in shapes.items()], "tree_id int, parents array<int>")
    return parsimony.tree_scores(_coded_patterns(d.cells(spark, sf_dir, 4)), some)


def _jc_sql() -> str:
    import math

    same, other = 0.25 + 0.75 * math.exp(-0.4 / 3), 0.25 - 0.25 * math.exp(-0.4 / 3)
    move = lambda c, s: f"(case when (({c} >> {s}) & 1) = 1 then {same!r}::double else {other!r}::double end)"
    terms = []
    for x in range(4):
        for y in range(4):
            p = same if x == y else other
            terms.append(f"{move('c1', x)} * {move('c2', x)} * {p!r}::double * {move('c3', y)} * {move('c4', y)}")
    return f"with p as ({_WIDE}) select weight, round(ln(0.25::double * ({' + '.join(terms)})), 9) as ll, cast(c1 as varchar) || ',' || c2 || ',' || c3 || ',' || c4 as pattern from p"


@query(_jc_sql())
def jukes_cantor_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _coded_patterns(d.cells(spark, sf_dir, 4))
    site = likelihood.jukes_cantor_site([F.element_at("codes", k) for k in (1, 2, 3, 4)], [0.1] * 5)
    return p.select("weight", F.round(F.log(site), 9).alias("ll"), "pattern")


@query(f"select round(sum(weight * ll), 6) as lnl from ({_jc_sql()})")
def tree_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree through the kernel that computes blocks of patterns."""
    p = _coded_patterns(d.cells(spark, sf_dir, 4)).withColumn("pattern_id", F.xxhash64("pattern"))
    one = spark.createDataFrame([(1, "(1:0.1,2:0.1,(3:0.1,4:0.1):0.1);")], "tree_id long, newick string")
    ll = likelihood.site_likelihoods(p, one, list("1234"), jukes_cantor())
    return statistics.tree_likelihoods(ll).select(F.round("lnl", 6).alias("lnl"))


@query(f"""
with c as ({d.cells_sql(12)}), n as (
  select a.taxon_id as taxon_a, b.taxon_id as taxon_b, count(*) as sites, count(*) filter (a.code <> b.code) as differ
  from c a join c b on a.site = b.site and a.taxon_id < b.taxon_id group by 1, 2)
select taxon_a, taxon_b, sites, differ, case when differ < 0.75 * sites then round(-0.75 * ln(1 - 4.0 * differ / sites / 3), 9) end as distance from n
""")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.pair_distances(d.cells(spark, sf_dir, 12)).withColumn("distance", F.round("distance", 9))


@query(f"""
with c as ({d.cells_sql(7)}), q as (
  select a.taxon_id as t1, b.taxon_id as t2, e.taxon_id as t3, f.taxon_id as t4, a.code as x, b.code as y, e.code as u, f.code as v
  from c a join c b on a.site = b.site and a.taxon_id < b.taxon_id join c e on e.site = a.site and b.taxon_id < e.taxon_id
  join c f on f.site = a.site and e.taxon_id < f.taxon_id)
select t1, t2, t3, t4, count(*) filter (x = y and u = v and x <> u) as s12, count(*) filter (x = u and y = v and x <> y) as s13,
  count(*) filter (x = v and y = u and x <> y) as s14 from q group by 1, 2, 3, 4
""")
def quartet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.quartet_scores(_coded_patterns(d.cells(spark, sf_dir, 7)), 7)


@query()
def gamma_tree_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three trees of four taxa under a general reversible model with gamma rates, branches at their best."""
    some = spark.createDataFrame([(1, "(1,2,(3,4));"), (2, "(1,3,(2,4));"), (3, "(1,4,(2,3));")], "tree_id long, newick string")
    model = gtr([1, 2, 1, 1, 2, 1], [0.3, 0.2, 0.2, 0.3], 0.7)
    return likelihood.evaluate_trees(_coded_patterns(d.cells(spark, sf_dir, 4)), some, list("1234"), model).select("tree_id", F.round("lnl", 3).alias("lnl"))


@query()
def stepwise_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsimony.stepwise(_coded_patterns(d.cells(spark, sf_dir, 10)), 10, spark.range(8).withColumnRenamed("id", "seed"))


@query()
def quartet_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.quartet_likelihoods(_coded_patterns(d.cells(spark, sf_dir, 5)), 5, jukes_cantor())


@query()
def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([(1, "(1,2,(3,(4,5)));"), (2, "(1,4,(3,(2,5)));")], "tree_id long, newick string")
    return likelihood.search(_coded_patterns(d.cells(spark, sf_dir, 5)), start, list("12345"), jukes_cantor())


def _reference_and_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = d.cells(spark, sf_dir, 5)
    ref = alignment.columns(c.where("taxon_id <= 4")).select(F.col("site").alias("pattern_id"), "codes", F.lit(1).cast("long").alias("weight"))
    e = d.table(spark, sf_dir, "embeddings")
    v = lambda x: F.when(x < -0.1, 1).when(x < 0, 2).when(x < 0.1, 4).otherwise(8)
    queries = e.select((F.col("vec_id") + 1).alias("query_id"), F.transform("embedding", lambda x: v(x.cast("double"))).alias("codes"))
    return ref, queries


@query()
def parsimony_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, queries = _reference_and_queries(spark, sf_dir)
    return statistics.most_parsimonious(parsimony.place(ref, queries, (1, 2, (3, 4))))


@query()
def likelihood_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, queries = _reference_and_queries(spark, sf_dir)
    placed = likelihood.place(ref, queries, "(1:0.3,2:0.3,(3:0.3,4:0.3):0.1);", list("1234"), jukes_cantor())
    return statistics.placement_weights(placed)


# --- tree sets


@query(f"select split_key, count(*) as n_trees from ({d.splits_sql(5)}) group by 1")
def split_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.frequencies(d.splits(spark, sf_dir, 5))


@query(f"""
with s as ({d.splits_sql(5)}), c as (select split_key, count(*) as n from s group by 1)
select r.split_key, cast(floor(0.5 + 100.0 * c.n / 8) as int) as support from (select split_key from s where tree_id = 0) r join c using (split_key)
""")
def split_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5)
    return splits.support(s.where("tree_id = 0").select("split_key"), s, 8)


@query(f"""
with s as ({d.splits_sql(5)}), t as (select tree_id, count(*) as n from s group by 1),
b as (select x.tree_id as a, y.tree_id as b, count(*) as n from s x join s y on x.split_key = y.split_key and x.tree_id < y.tree_id group by 1, 2)
select x.tree_id as tree_a, y.tree_id as tree_b, cast(x.n + y.n - 2 * coalesce(b.n, 0) as bigint) as rf
from t x join t y on x.tree_id < y.tree_id left join b on b.a = x.tree_id and b.b = y.tree_id
""")
def rf_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5)
    return splits.rf_distances(s, s.select("tree_id").distinct())


@query(f"""
with s as (select tree_id, split_key, cast(10 + split_key % 90 + tree_id as bigint) as support from ({d.splits_sql(5)})),
t as (select distinct tree_id from s), k as (select distinct split_key from s)
select a.tree_id as tree_a, b.tree_id as tree_b, round(sum(abs(coalesce(x.support, 0) - coalesce(y.support, 0))) / 100.0, 6) as wrf
from t a join t b on a.tree_id < b.tree_id cross join k left join s x on x.tree_id = a.tree_id and x.split_key = k.split_key
left join s y on y.tree_id = b.tree_id and y.split_key = k.split_key group by 1, 2
""")
def weighted_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5).withColumn("support", 10 + F.col("split_key") % 90 + F.col("tree_id"))
    return splits.weighted_rf(s).withColumn("wrf", F.round("wrf", 6))


@query(f"select split_key, count(*) as n_trees from ({d.splits_sql(4)}) group by 1 having count(*) > 4")
def majority_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.consensus(d.splits(spark, sf_dir, 4), 8)


@query()
def extended_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 6).where((F.bit_count("split_key") >= 2) & (F.bit_count("split_key") <= 4))
    return splits.extended_consensus(s, 8, 6)


@query(f"""
with s as ({d.splits_sql(5)}), c as (select split_key, count(*) as n_trees from s group by 1)
select r.split_key, c.split_key as other, c.n_trees from (select split_key from s where tree_id = 0) r
join c on not ((r.split_key & c.split_key) = 0 or (r.split_key & c.split_key) = r.split_key or (r.split_key & c.split_key) = c.split_key)
""")
def split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5)
    return splits.conflicts(s.where("tree_id = 0"), splits.frequencies(s))


@query()
def internode_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5)
    return splits.internode_certainty(s.where("tree_id = 0").select("split_key"), splits.frequencies(s), 8)


@query(f"""
with s as ({d.splits_sql(5)}), a as (select split_key, count(*) / 4.0 as x from s where tree_id < 4 group by 1),
b as (select split_key, count(*) / 4.0 as y from s where tree_id >= 4 group by 1),
f as (select coalesce(x, 0) as x, coalesce(y, 0) as y from a full join b using (split_key))
select round(case when max(abs(x - y)) = 0 then 1 when var_pop(x) = 0 or var_pop(y) = 0 then 0 else covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end, 9) as r from f
""")
def split_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5)
    return splits.split_correlation(s.where("tree_id < 4"), 4, s.where("tree_id >= 4"), 4).select(F.round("r", 9).alias("r"))


@query(f"""
with s as ({d.splits_sql(5)}), t as (select distinct tree_id from s),
h as (select perm, tree_id, (row_number() over (partition by perm order by md5(perm || '-' || tree_id), tree_id) - 1) % 2 as half from t, range(20) p(perm)),
c as (select perm, split_key, sum((half = 0)::int) as x, sum((half = 1)::int) as y from h join s using (tree_id) group by 1, 2)
select cast(perm as int) as perm, round(case when max(abs(x - y)) = 0 then 1 when var_pop(x) = 0 or var_pop(y) = 0 then 0 else covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end, 9) as r
from c group by perm
""")
def bootstop_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.splits(spark, sf_dir, 5)
    halves = splits.bootstop_halves(s.select("tree_id").distinct(), 20)
    return splits.bootstop_frequency(s, 8, halves).withColumn("r", F.round("r", 9))


@query(f"""
with s as ({d.splits_sql(6)}), t as (select cast(k as int) as taxon from range(1, 6) r(k)),
w as (select distinct tree_id, taxon, split_key & (63 - (1 << taxon)) as key from s, t), i as (select * from w where bit_count(key) between 2 and 3),
a as (select taxon, count(*) as n from (select taxon, key from i group by 1, 2 having count(*) > 4) group by 1),
b as (select count(*) as n from (select split_key from s group by 1 having count(*) > 4))
select t.taxon, cast(coalesce(a.n, 0) - b.n as bigint) as gain from t left join a using (taxon), b
""")
def rogue_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rogue_gains(d.splits(spark, sf_dir, 6), 8, 6)


@query("""
select cast(o_orderkey as int) as tree_id, cast(n as bigint) as split_key from (
  select o_orderkey, unnest([case when o_custkey % 3 = 0 then 6 when o_custkey % 3 = 1 then 10 else 12 end, 14, 30]) as n from orders)
where bit_count(n) between 2 and 3
""")
def newick_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of five taxa written from orders and read back."""
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 3
    inner = F.when(k == 0, "((b,c),d)").when(k == 1, "((b:0.5,d)x:0.1,c)").otherwise("((c,'d'),b[note])")
    newick = F.concat(F.lit("(a,"), inner, F.lit(",e);"))
    found = trees.splits(o.select(F.col("o_orderkey").cast("int").alias("tree_id"), newick.alias("newick")), {n: i + 1 for i, n in enumerate("abcde")})
    return found.select("tree_id", "split_key")


# --- resampling and statistics

_SEED = 12345


@query(f"""
with recursive s(k, x) as (select 1, cast({_SEED} * 1664525::hugeint % 4294967296 as bigint) union all
  select k + 1, cast(x::hugeint * 1664525 % 4294967296 as bigint) from s where k < 640)
select (k - 1) // 64 as replicate, cast(floor(x / 4294967296.0 * 64) + 1 as int) as site, count(*) as weight from s group by 1, 2
""")
def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bootstrap_weights(d.SITES, spark.range(10).select(F.col("id").cast("int").alias("replicate")), _SEED)


@query(f"""
with recursive s(k, x) as (select 1, cast({_SEED} * 1664525::hugeint % 4294967296 as bigint) union all
  select k + 1, cast(x::hugeint * 1664525 % 4294967296 as bigint) from s where k < 640)
select cast(k as bigint) as k, x as state, x / 4294967296.0 as u from s
""")
def random_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.range(1, 641).select(F.col("id").alias("k"))
    return k.select("k", rng.state(_SEED, F.col("k")).alias("state"), rng.uniform(_SEED, F.col("k")).alias("u"))


@query(f"""
with l as ({d.site_ll_sql(5)}), x as (select l.tree_id, l.weight as w, r.ll - l.ll as d from l join l r on r.pattern_id = l.pattern_id and r.tree_id = 1),
s as (select tree_id, sum(w) as w, sum(w * d) as s, sum(w * d * d) as q from x group by 1),
v as (select tree_id, s as diff, sqrt(greatest(w * (q - s * s / w) / (w - 1), 0)) as sd from s)
select tree_id, round(diff, 6) as diff, round(sd, 6) as sd, diff > 1.95996 * sd as at_5, diff > 2.326 * sd as at_2, diff > 2.57583 * sd as at_1 from v
""")
def likelihood_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = statistics.likelihood_test(d.site_ll(spark, sf_dir, 5), 1)
    return t.withColumn("diff", F.round("diff", 6)).withColumn("sd", F.round("sd", 6))


_WEIGHTED = f"""
with recursive g(k, x) as (select 1, cast({_SEED} * 1664525::hugeint % 4294967296 as bigint) union all
  select k + 1, cast(x::hugeint * 1664525 % 4294967296 as bigint) from g where k < 1280),
w as (select (k - 1) // 64 as replicate, cast(floor(x / 4294967296.0 * 64) + 1 as int) as site, count(*) as times from g group by 1, 2),
l as (select w.replicate, t.tree_id, sum(w.times * t.ll) as lnl from w join ({d.site_ll_sql(5)}) t on t.pattern_id = w.site group by 1, 2)"""


def _resampled(spark: SparkSession) -> DataFrame:
    w = statistics.bootstrap_weights(d.SITES, spark.range(20).select(F.col("id").cast("int").alias("replicate")), _SEED)
    return w.withColumnRenamed("site", "pattern_id")


@query(_WEIGHTED + """,
e as (select *, exp(lnl - max(lnl) over (partition by replicate)) as e from l), p as (select tree_id, e / sum(e) over (partition by replicate) as p from e),
a as (select tree_id, avg(p) as elw from p group by 1)
select tree_id, round(elw, 6) as elw, round(sum(elw) over (order by elw desc, tree_id), 6) as cumulative from a
""")
def expected_likelihood_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = statistics.expected_weights(d.site_ll(spark, sf_dir, 5), _resampled(spark))
    return e.select("tree_id", F.round("elw", 6).alias("elw"), F.round("cumulative", 6).alias("cumulative"))


@query(_WEIGHTED + "select tree_id, count(*) as wins from (select replicate, tree_id, row_number() over (partition by replicate order by lnl desc, tree_id) as r from l) where r = 1 group by 1")
def resampled_best_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.best_by_replicate(d.site_ll(spark, sf_dir, 5), _resampled(spark))


@query(f"""
with l as (select tree_id as branch, pattern_id as site, ll from ({d.site_ll_sql(6)})),
s as (select branch, site, sum(ll) over w as s, count(*) over w as n from l window w as (partition by branch order by site rows between current row and 9 following))
select site, branch, round(s, 6) as ll from (select *, row_number() over (partition by site order by s desc, branch) as r from s where n = 10) where r = 1
""")
def window_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll = d.site_ll(spark, sf_dir, 6).select(F.col("tree_id").alias("branch"), F.col("pattern_id").alias("site"), "ll")
    return statistics.window_bias(ll, 10).withColumn("ll", F.round("ll", 6))


@query(f"""
with l as ({d.site_ll_sql(20)}) select a.pattern_id, count(*) filter (a.ll <= r.ll) as n from l a join l r on r.pattern_id = a.pattern_id and r.tree_id = 1
where a.tree_id <> 1 group by 1
""")
def significance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.not_above(d.site_ll(spark, sf_dir, 20), 1)


_PLACED = f"select cast(tree_id as int) as query_id, cast(pattern_id as int) as edge, 40 * ll as lnl from ({d.site_ll_sql(50)})"
_SOFTMAX = f"with p as ({_PLACED}), e as (select *, exp(lnl - max(lnl) over (partition by query_id)) as e from p), w as (select *, e / sum(e) over (partition by query_id) as lwr, row_number() over (partition by query_id order by lnl desc, edge) as rank from e)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll = d.site_ll(spark, sf_dir, 50)
    return ll.select(F.col("tree_id").alias("query_id"), F.col("pattern_id").alias("edge"), (40 * F.col("ll")).alias("lnl"))


@query(_SOFTMAX + "select query_id, cast(rank as int) as rank, edge, round(lwr, 6) as lwr from w where rank <= 7 and e >= 0.01")
def placement_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.placement_weights(_placed(spark, sf_dir)).withColumn("lwr", F.round("lwr", 6))


@query(_SOFTMAX + """, r as (select *, sum(lwr) over (partition by query_id order by lnl desc, edge rows unbounded preceding) as run from w)
select query_id, cast(rank as int) as rank, edge, round(lwr, 6) as lwr from r where run - lwr <= 0.95""")
def accumulated_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.accumulated_placements(_placed(spark, sf_dir)).withColumn("lwr", F.round("lwr", 6))


@query(_SOFTMAX + "select query_id, round(-sum(lwr * ln(lwr)) / ln(count(*)), 6) as entropy from w group by 1")
def placement_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.placement_entropy(_placed(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@query(_SOFTMAX + "select query_id, edge from w where rank <= 6")
def heuristic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_edges(_placed(spark, sf_dir), 64, 0.1)


@query("""
with t as (select cast(o_orderkey as bigint) as tree_id, o_orderpriority || '-' || o_orderstatus as topology, -o_totalprice as lnl from orders),
b as (select *, row_number() over (partition by topology order by lnl desc, tree_id) as r from t)
select cast(row_number() over (order by lnl desc, tree_id) as int) as rank, tree_id, topology, lnl from b where r = 1 order by lnl desc, tree_id limit 10
""")
def best_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = d.table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderkey").alias("tree_id"), F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("topology"), (-F.col("o_totalprice")).alias("lnl"))
    return statistics.best_topologies(t, 10)


@query("""
with f as (select p_brand as model, -sum(p_retailprice) as lnl, cast(count(*) as bigint) as k from part group by 1)
select model, round(2 * k - 2 * lnl, 4) as aic, case when 1000 - k - 1 > 0 then round(2 * k - 2 * lnl + 2.0 * k * (k + 1) / (1000 - k - 1), 4) end as aicc,
  round(k * ln(1000) - 2 * lnl, 4) as bic from f
""")
def information_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg((-F.sum("p_retailprice")).alias("lnl"), F.count(F.lit(1)).alias("k"))
    c = statistics.information_criteria(p, 1000)
    return c.select("model", *[F.round(x, 4).alias(x) for x in ("aic", "aicc", "bic")])
