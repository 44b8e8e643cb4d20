"""Phylogenetic tables derived from the business tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sums of millionths, brought into a range around 0.
_RANGE = 600_011


def values(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(taxon_id, site, v): all vectors, n sums of components for each site: vector k counts for taxon k % n + 1, in whole millionths,
    and the sum's remainder gives a value of either sign."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % n + 1).cast("int").alias("taxon_id"), F.posexplode("embedding").alias("p", "x"))
    whole = F.floor(F.col("x").cast("double") * 1_000_000)
    sums = e.groupBy("taxon_id", (F.col("p") + 1).cast("int").alias("site")).agg(F.sum(whole).alias("s"))
    return sums.select("taxon_id", "site", ((F.pmod("s", F.lit(_RANGE)) - _RANGE // 2) / F.lit(1e6)).alias("v"))


def values_sql(n: int) -> str:
    return f"""select taxon_id, site, (((s % {_RANGE}) + {_RANGE}) % {_RANGE} - {_RANGE // 2}) / 1e6::double as v from (
  select cast(vec_id % {n} + 1 as int) as taxon_id, cast(site as int) as site, cast(sum(cast(floor(x * 1000000) as bigint)) as bigint) as s from (
    select vec_id, generate_subscripts(embedding, 1) as site, cast(unnest(embedding) as double) as x from embeddings) group by 1, 2)"""


#: Quartile cuts make nucleotides; values near 0 are undetermined in the ambiguous alignment.
def cells(spark: SparkSession, sf_dir: str, n: int, ambiguous: bool = False) -> DataFrame:
    v = F.col("v")
    code = F.when(v < -0.1, 1).when(v < 0, 2).when(v < 0.1, 4).otherwise(8)
    if ambiguous:
        code = F.when(F.abs(v) < 0.02, 15).when((v > 0.15) & (v < 0.2), 12).otherwise(code)
    return values(spark, sf_dir, n).select("taxon_id", "site", code.alias("code"))


def cells_sql(n: int, ambiguous: bool = False) -> str:
    special = "when abs(v) < 0.02 then 15 when v > 0.15 and v < 0.2 then 12 " if ambiguous else ""
    return f"""select taxon_id, site, cast(case {special}when v < -0.1 then 1 when v < 0 then 2 when v < 0.1 then 4 else 8 end as int) as code
  from ({values_sql(n)})"""


def splits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(tree_id, split_key): eight sign masks a tree; they need not fit together."""
    bit = F.when(F.col("v") > 0, F.expr("shiftleft(1L, taxon_id - 1)")).otherwise(0)
    b = values(spark, sf_dir, n).groupBy("site").agg(F.sum(bit).alias("b"))
    key = F.when(F.col("b") % 2 == 1, F.lit((1 << n) - 1) - F.col("b")).otherwise(F.col("b"))
    return b.select(F.floor((F.col("site") - 1) / 8).cast("int").alias("tree_id"), key.alias("split_key")).distinct()


def splits_sql(n: int) -> str:
    return f"""select distinct cast((site - 1) // 8 as int) as tree_id, case when b % 2 = 1 then {(1 << n) - 1} - b else b end as split_key
  from (select site, cast(sum(case when v > 0 then cast(power(2, taxon_id - 1) as bigint) else 0 end) as bigint) as b from ({values_sql(n)}) group by site)"""


def site_ll(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(tree_id, pattern_id, weight, ll): stand-ins for site likelihoods."""
    return values(spark, sf_dir, n).select(
        F.col("taxon_id").alias("tree_id"), F.col("site").alias("pattern_id"), (F.col("site") % 3 + 1).cast("long").alias("weight"), (-1.0 - F.abs("v")).alias("ll")
    )


def site_ll_sql(n: int) -> str:
    return f"select taxon_id as tree_id, site as pattern_id, cast(site % 3 + 1 as bigint) as weight, -1.0 - abs(v) as ll from ({values_sql(n)})"


def all_values(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(taxon_id, site, v): all vectors. Blocks of n vectors follow one another in one long alignment: taxon_id is vec_id % n + 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    site = F.floor(F.col("vec_id") / n) * SITES + F.col("p") + 1
    return e.select((F.col("vec_id") % n + 1).cast("int").alias("taxon_id"), site.cast("long").alias("site"), F.col("x").cast("double").alias("v"))


def all_values_sql(n: int) -> str:
    return f"""select cast(vec_id % {n} + 1 as int) as taxon_id, cast(vec_id // {n} * {SITES} + site as bigint) as site, cast(v as double) as v
  from (select vec_id, generate_subscripts(embedding, 1) as site, unnest(embedding) as v from embeddings)"""


def all_cells(spark: SparkSession, sf_dir: str, n: int, ambiguous: bool = False) -> DataFrame:
    """(taxon_id, site, code) of all_values(); taxa that a block doesn't have are undetermined there."""
    v = F.col("v")
    code = F.when(v < -0.1, 1).when(v < 0, 2).when(v < 0.1, 4).otherwise(8)
    if ambiguous:
        code = F.when(F.abs(v) < 0.02, 15).when((v > 0.15) & (v < 0.2), 12).otherwise(code)
    known = all_values(spark, sf_dir, n).select("taxon_id", "site", code.alias("code"))
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    wanted = ids.select(F.floor(F.col("vec_id") / n).alias("block")).distinct().select("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    missing = wanted.select((F.col("block") * n + F.col("k")).alias("vec_id"), "block", "k").join(ids, "vec_id", "left_anti")
    filled = missing.select((F.col("k") + 1).alias("taxon_id"), F.explode(F.sequence(F.col("block") * SITES + 1, (F.col("block") + 1) * SITES)).alias("site"))
    return known.union(filled.select("taxon_id", "site", F.lit(15).alias("code")))


def all_cells_sql(n: int, ambiguous: bool = False) -> str:
    special = "when abs(v) < 0.02 then 15 when v > 0.15 and v < 0.2 then 12 " if ambiguous else ""
    return f"""select * from (select taxon_id, site, cast(case {special}when v < -0.1 then 1 when v < 0 then 2 when v < 0.1 then 4 else 8 end as int) as code
  from ({all_values_sql(n)}) union all select cast(k + 1 as int), cast(block * {SITES} + s as bigint), 15
  from (select distinct vec_id // {n} as block from embeddings), range({n}) a(k), range(1, {SITES + 1}) b(s)
  where block * {n} + k not in (select vec_id from embeddings))"""


def all_splits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(tree_id, split_key): eight trees for each block of n vectors; taxa that a block doesn't have are on side 0."""
    bit = F.when(F.col("v") > 0, F.expr("shiftleft(1L, taxon_id - 1)")).otherwise(0)
    b = all_values(spark, sf_dir, n).groupBy("site").agg(F.sum(bit).alias("b"))
    key = F.when(F.col("b") % 2 == 1, F.lit((1 << n) - 1) - F.col("b")).otherwise(F.col("b"))
    return b.select(F.floor((F.col("site") - 1) / 8).alias("tree_id"), key.alias("split_key")).distinct()


def all_splits_sql(n: int) -> str:
    return splits_sql(n).replace(values_sql(n), all_values_sql(n))


def all_site_ll(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(tree_id, pattern_id, weight, ll) of n trees over the sites of all blocks."""
    return all_values(spark, sf_dir, n).select(
        F.col("taxon_id").alias("tree_id"), F.col("site").alias("pattern_id"), (F.col("site") % 3 + 1).cast("long").alias("weight"), (-1.0 - F.abs("v")).alias("ll")
    )
