"""Mixing sources to target weights by thresholds on a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Bits of the hash that each level of the histograms takes, and the number of levels.
BITS, LEVELS = 12, 3
#: Sources up to which their table is broadcast; beyond, it is joined like any other.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_digits(doc_id: Column) -> Column:
    """The first nine hexadecimal digits of the id's MD5: three for each level."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)


def source_targets(sizes: DataFrame, ratios: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds weight and target.

    Sources in order of code points, null last, weigh `ratios` in turn and share the sum of all sizes; no target is
    above `most` times its source's size, and what is above goes to the others by weight. Sources are taken by
    growing cap / weight: as soon as one stays below its cap, all later ones do.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, ratios)), ((F.row_number().over(every) - 1) % len(ratios) + 1).cast("int")).alias("weight"),
    ).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    shared = (
        weighed.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")).cast("double") / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("free"), F.struct("caps_before", "level"))).over(whole)["level"]
    return shared.select(
        "source",
        "source_size",
        F.when(F.col("free"), level * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def plan_mix(doc: DataFrame, ratios: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc: (source, size, digits). A row per source: source, source_size, target, whole, below. A document is taken
    `whole` times, and once more if its digits come before `below`.

    The threshold comes from sums of sizes by source and hash bucket: the boundary bucket alone is summed again by the next
    bits of the hash, down to LEVELS levels, and joins if that brings the source nearer to its target.
    """
    sizes = materialize(doc.groupBy("source").agg(F.sum("size").alias("source_size")))
    small = _joined_as(sizes.count())
    plan = source_targets(sizes, ratios, most).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    )
    plan = materialize(
        plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below", F.lit(""))
    )
    step = BITS // 4
    for level in range(LEVELS):
        # sums of the boundary bucket's documents by their next digits
        at = plan.select(F.col("source").alias("s"), F.col("below").alias("prefix"))
        inside = doc.join(
            small(at), F.col("source").eqNullSafe(F.col("s")) & (F.substring("digits", 1, level * step) == F.col("prefix"))
        )
        sums = inside.groupBy("source", F.substring("digits", level * step + 1, step).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "s")
        over = (
            sums.join(small(plan.select(F.col("source").alias("p"), "budget")), F.col("s").eqNullSafe(F.col("p")))
            .where("upto > budget")
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
        )
        plan = plan.join(over, F.col("source").eqNullSafe(F.col("s")), "left")
        last = level == LEVELS - 1
        rest = F.col("budget") - (F.col("b.upto") - F.col("b.n"))
        # the last boundary bucket joins when that overshoots by less than leaving it falls short
        take = (F.col("b.n") - rest < rest) if last else F.lit(False)
        bound = F.coalesce(F.col("b.bucket"), F.lit(""))  # none: a source without words
        plan = materialize(
            plan.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(rest).alias("budget"),
                F.concat("below", bound, F.when(F.col("b").isNotNull() & take, F.lit("~")).otherwise(F.lit(""))).alias("below"),
            )
        )
    return plan.drop("budget")


def _joined_as(n_sources: int):
    return (lambda t: F.broadcast(t)) if n_sources <= BROADCAST_SOURCES else (lambda t: t)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, digits) of the documents, written once, so that texts are read once."""
    return materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            n_words(F.col(f"`{text_col}`")).alias("size"),
        ).withColumn("digits", hash_digits(F.col("id")))
    )


def _copies(most: int) -> Column:
    return F.least(F.col("whole") + (F.col("digits") < F.col("below")).cast("long"), F.lit(most))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    ratios: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (= size x copies).

    Every document of a source is taken as often as its target holds the source in whole; documents whose hash lies
    below the source's threshold are taken once more (see plan_mix). Nothing is sorted by hash, and a source that holds
    most rows sends at most 2**BITS sums per task. The hash depends on the id alone, so reruns agree and a smaller
    target takes a subset of what a larger one takes.

    Null texts and texts without words have size 0. Null sources are one source. Rows with one id share a hash and are taken
    alike. A source without words has target 0. An empty table gives no rows. Other columns are ignored.
    """
    doc = _sized(docs, id_col, text_col, source_col)
    plan = plan_mix(doc, ratios, most).withColumnRenamed("source", "s")
    return (
        doc.join(_joined_as(plan.count())(plan), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", _copies(most))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    ratios: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
) -> DataFrame:
    """The documents of the mix with their own columns, each as often as the mix takes it: the small table of thresholds
    comes to the documents, so that no text is shuffled. Nulls, repeated rows and empty tables as in mix."""
    plan = plan_mix(_sized(docs, id_col, text_col, source_col), ratios, most)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).select(
        "doc", hash_digits(F.col(f"doc.`{id_col}`")).alias("digits"), F.col(f"doc.`{source_col}`").cast("string").alias("source")
    )
    plan = plan.select(F.col("source").alias("s"), "whole", "below")
    joined = row.join(_joined_as(plan.count())(plan), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies(most))
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


ORACLE_SQL = """
with recursive d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 9) as digits
  from documents
), s0 as (select source, sum(size) as source_size from d group by 1),
s1 as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3 * source_size as cap from s0),
s2 as (
  select *, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cast(cap as double) / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as caps_before,
    sum(weight) over (order by cast(cap as double) / weight, source nulls last rows between current row and unbounded following) as weight_left
  from s1
), s3 as (select *, cast(total - caps_before as double) / weight_left as level from s2),
s4 as (select *, level * weight <= cap as free from s3),
lev as (select arg_min(level, caps_before) as level from s4 where free),
t as (
  select s4.source, cast(source_size as bigint) as source_size, case when free then lev.level * weight else cast(cap as double) end as target
  from s4 left join lev on true
), t2 as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t
), h as (select source, digits, sum(size) as n from d group by 1, 2),
c as (
  select h.*, sum(n) over (partition by h.source order by digits) as upto from h
), f as (
  select c.source, c.digits, c.upto <= r.budget as fits,
         c.upto > r.budget and c.upto - c.n <= r.budget and row_number() over (partition by c.source, c.upto > r.budget order by c.digits) = 1
           and c.n - (r.budget - (c.upto - c.n)) < (r.budget - (c.upto - c.n)) as joins
  from c join (select source, target - whole * source_size as budget from t2) r on r.source is not distinct from c.source
)
select d.doc_id, d.size, t2.source_size, t2.target,
  least(t2.whole + case when t2.source_size > 0 and (f.fits or f.joins) then 1 else 0 end, 3) as copies,
  cast(d.size * least(t2.whole + case when t2.source_size > 0 and (f.fits or f.joins) then 1 else 0 end, 3) as bigint) as taken
from d join t2 on t2.source is not distinct from d.source
join f on f.source is not distinct from d.source and f.digits = d.digits
"""
