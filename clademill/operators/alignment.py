"""Alignments: from sequences to cells (taxon_id, site, code) and weighted site patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import UNDETERMINED, code_of


def cells(sequences: DataFrame, data_type: str = "DNA") -> DataFrame:
    """sequences: (taxon_id, seq). A row per character: taxon_id, site (from 1), code; code is null for illegal characters."""
    chars = sequences.select("taxon_id", F.posexplode(F.split("seq", "")).alias("p", "ch")).where("ch <> ''")
    return chars.select("taxon_id", (F.col("p") + 1).alias("site"), code_of(F.col("ch"), data_type).alias("code"))


def illegal(sequences: DataFrame, data_type: str = "DNA") -> DataFrame:
    """(taxon_id, site) of characters that the data type doesn't have."""
    return cells(sequences, data_type).where("code is null").select("taxon_id", "site")


def columns(cell: DataFrame) -> DataFrame:
    """(site, codes): each site's codes by taxon. A column has one entry per taxon, which bounds the group."""
    in_order = F.array_sort(F.collect_list(F.struct("taxon_id", "code")))
    return cell.groupBy("site").agg(F.transform(in_order, lambda x: x["code"]).alias("codes"))


def patterns(cell: DataFrame, weights: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(part_id, pattern, weight): distinct columns of each partition with the sum of their sites' weights (1 without weights).

    weights: (site, weight); parts: (site, part_id), 0 for all without.
    """
    column = columns(cell).select("site", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("pattern"))
    column = column.join(weights, "site") if weights is not None else column.withColumn("weight", F.lit(1))
    column = column.join(parts, "site") if parts is not None else column.withColumn("part_id", F.lit(0))
    return column.groupBy("part_id", "pattern").agg(F.sum("weight").cast("long").alias("weight"))


def drop_undetermined(cell: DataFrame, data_type: str = "DNA") -> DataFrame:
    """Without the sites at which every taxon is undetermined."""
    bad = cell.groupBy("site").agg(F.max((F.col("code") != UNDETERMINED[data_type]).cast("int")).alias("some")).where("some = 0")
    return cell.join(bad.select("site"), "site", "left_anti")


def undetermined_taxa(cell: DataFrame, data_type: str = "DNA") -> DataFrame:
    """taxon_id of sequences without any determined character."""
    known = F.max((F.col("code") != UNDETERMINED[data_type]).cast("int"))
    return cell.groupBy("taxon_id").agg(known.alias("known")).where("known = 0").select("taxon_id")


def duplicates(sequences: DataFrame) -> DataFrame:
    """(taxon_id, same_as): later sequences that equal an earlier one, with the first of them. Equal sequences meet by digest,
    so that a sequence isn't shuffled whole."""
    rows = sequences.select("taxon_id", F.sha2("seq", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("taxon_id").alias("same_as"))
    return rows.join(first, "h").where("taxon_id > same_as").select("taxon_id", "same_as")


def repeated_names(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def informative(cell: DataFrame, data_type: str = "DNA") -> DataFrame:
    """(site, n_codes, most): sites with two or more determined codes, one of which occurs twice or more."""
    counts = cell.where(F.col("code") < UNDETERMINED[data_type]).groupBy("site", "code").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("site").agg(F.count(F.lit(1)).alias("n_codes"), F.max("n").alias("most"))
    return found.where("n_codes >= 2 and most >= 2")


def invariant(cell: DataFrame) -> DataFrame:
    """(site, mask): sites that one state can explain; codes are masks of states."""
    return cell.groupBy("site").agg(F.bit_and("code").cast("int").alias("mask")).where("mask > 0")


def presence(cell: DataFrame, parts: DataFrame, data_type: str = "DNA") -> DataFrame:
    """(taxon_id, part_id, has_data): whether a taxon has a determined character in a partition."""
    some = F.max(F.col("code") != UNDETERMINED[data_type])
    return cell.join(parts, "site").groupBy("taxon_id", "part_id").agg(some.alias("has_data"))


def only_partition(present: DataFrame) -> DataFrame:
    """(taxon_id, part_id, n_parts) of a read's data; reads of one partition have n_parts 1."""
    return present.where("has_data").groupBy("taxon_id").agg(F.min("part_id").alias("part_id"), F.count(F.lit(1)).alias("n_parts"))


def exclude(cell: DataFrame, ranges: DataFrame) -> DataFrame:
    """Without the sites of ranges (lo, hi), the others renumbered from 1; ranges may overlap."""
    gone = ranges.select(F.explode(F.sequence("lo", "hi")).alias("gone")).distinct()
    left = cell.join(gone, F.col("site") == F.col("gone"), "left_anti")
    # sites are few beside cells: each block of sites is counted, then numbered within
    site = left.select("site").distinct().withColumn("block", F.floor(F.col("site") / 1024))
    sizes = site.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("block").orderBy("site"))
    numbered = site.withColumn("k", number).join(before, "block").select(F.col("site").alias("old"), (F.col("before") + F.col("k")).cast("int").alias("new"))
    return left.join(numbered, F.col("site") == F.col("old")).select("taxon_id", F.col("new").alias("site"), "code")


def partition_sites(partitions: DataFrame) -> DataFrame:
    """(site, part_id) of partitions (part_id, ranges array<struct<lo, hi, stride>>)."""
    r = partitions.select("part_id", F.explode("ranges").alias("r"))
    return r.select(F.explode(F.sequence("r.lo", "r.hi", "r.stride")).alias("site"), "part_id")


def overlaps(parts: DataFrame) -> DataFrame:
    """(site, n): sites in more than one partition."""
    return parts.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def partition_shares(pattern: DataFrame) -> DataFrame:
    """(part_id, weight, share): each partition's part of all weight."""
    sums = pattern.groupBy("part_id").agg(F.sum("weight").alias("weight"))
    total = sums.agg(F.sum("weight").alias("total"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("part_id", "weight", (F.col("weight") / F.col("total")).alias("share"))


def base_frequencies(cell: DataFrame, states: int = 4, rounds: int = 8) -> DataFrame:
    """(state, freq): expectation maximisation over the masks' counts: an ambiguous code counts for its states by their
    frequencies so far. Cells with a column weight count that often. The counts have at most 2**states rows."""
    counts = cell.groupBy("code").agg((F.sum("weight") if "weight" in cell.columns else F.count(F.lit(1))).alias("n"))
    one = counts.select("n", F.array(*[F.shiftright("code", s).bitwiseAND(1).cast("double") for s in range(states)]).alias("has"))
    freq = one.agg(F.array(*[F.lit(1.0 / states)] * states).alias("f"))
    for _ in range(rounds):
        shared = one.crossJoin(F.broadcast(freq)).withColumn("p", F.zip_with("has", "f", lambda a, b: a * b))
        shared = shared.withColumn("all", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
        sums = [F.sum(F.col("n") * F.col("p")[s] / F.col("all")) for s in range(states)]
        total = sum(sums[1:], sums[0])
        freq = shared.agg(F.array(*[s / total for s in sums]).alias("f"))
    return freq.select(F.posexplode("f").alias("state", "freq"))


def paired_sites(structure: DataFrame) -> DataFrame:
    """structure: (site, symbol). (left, right): sites that brackets ( < [ { pair. Of each kind and depth, sites alternate between
    opening and closing ones."""
    opens, closes = "(<[{", ")>]}"
    at = lambda s: F.expr(f"instr('{s}', symbol)")
    marks = structure.where("symbol <> '.'").withColumn("kind", F.greatest(at(opens), at(closes)))
    marks = marks.withColumn("step", F.when(at(opens) > 0, 1).otherwise(-1))
    run = Window.partitionBy("kind").orderBy("site").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = marks.withColumn("sum", F.sum("step").over(run)).withColumn("depth", F.col("sum") + F.when(F.col("step") < 0, 1).otherwise(0))
    k = F.row_number().over(Window.partitionBy("kind", "depth", "step").orderBy("site"))
    numbered = deep.withColumn("k", k)
    left = numbered.where("step = 1").select("kind", "depth", "k", F.col("site").alias("left"))
    right = numbered.where("step = -1").select("kind", "depth", "k", F.col("site").alias("right"))
    return left.join(right, ["kind", "depth", "k"]).select("left", "right")
