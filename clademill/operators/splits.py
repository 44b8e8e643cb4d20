"""Splits of tree sets: a table (tree_id, split_key), split_key being a mask of taxa (bit i: taxon i + 1) with taxon 1 on side 0."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(mask: Column, n_taxa: int) -> Column:
    """The mask or its complement, whichever leaves taxon 1 out."""
    return F.when(mask.bitwiseAND(1) == 1, F.lit((1 << n_taxa) - 1) - mask).otherwise(mask)


def compatible(a: Column, b: Column) -> Column:
    """Whether two normalised splits fit in one tree: they are disjoint or one holds the other."""
    both = a.bitwiseAND(b)
    return (both == 0) | (both == a) | (both == b)


def frequencies(splits: DataFrame) -> DataFrame:
    """(split_key, n_trees)."""
    return splits.groupBy("split_key").agg(F.count(F.lit(1)).alias("n_trees"))


def support(reference: DataFrame, splits: DataFrame, n_trees: int) -> DataFrame:
    """reference: (split_key). Adds support: the share of trees with the split in percent, halves rounded up."""
    found = reference.join(frequencies(splits), "split_key", "left")
    return found.select("split_key", F.floor(0.5 + 100.0 * F.coalesce("n_trees", F.lit(0)) / n_trees).cast("int").alias("support"))


def rf_distances(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """trees: (tree_id). (tree_a, tree_b, rf) for all pairs a < b: splits in one tree but not in the other.

    Trees with the same splits are one topology first, and splits that all topologies share are set aside: they add nothing. Every
    pair of trees is a row of the result, so its size is the square of the trees by definition.
    """
    topology = splits.groupBy("tree_id").agg(F.array_sort(F.collect_set("split_key")).alias("keys"))
    topology = trees.join(topology, "tree_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    first = topology.groupBy("keys").agg(F.min("tree_id").alias("topo"))
    distinct = first.select("topo", F.size("keys").alias("size"), F.explode("keys").alias("k"))
    sizes = first.select("topo", F.size("keys").alias("size"))
    a = distinct.select(F.col("topo").alias("x"), "k")
    b = distinct.select(F.col("topo").alias("y"), F.col("k").alias("k2"))
    shared = a.join(b, (F.col("k") == F.col("k2")) & (F.col("x") < F.col("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("both"))
    member = topology.join(first, "keys").join(sizes, "topo").select("tree_id", "topo", "size")
    left = member.select(F.col("tree_id").alias("tree_a"), F.col("topo").alias("ta"), F.col("size").alias("sa"))
    right = member.select(F.col("tree_id").alias("tree_b"), F.col("topo").alias("tb"), F.col("size").alias("sb"))
    pairs = left.join(right, F.col("tree_a") < F.col("tree_b"))
    key = (F.least("ta", "tb") == F.col("x")) & (F.greatest("ta", "tb") == F.col("y"))
    same = F.col("ta") == F.col("tb")
    rf = F.when(same, 0).otherwise(F.col("sa") + F.col("sb") - 2 * F.coalesce("both", F.lit(0)))
    return pairs.join(shared, key, "left").select("tree_a", "tree_b", rf.cast("long").alias("rf"))


def weighted_rf(splits: DataFrame) -> DataFrame:
    """splits: (tree_id, split_key, support). (tree_a, tree_b, wrf): the sum over splits of support differences, in hundredths, a missing
    split having none. Pairs come from trees that share splits or not alike: sums over each tree less what pairs share."""
    a = splits.select(F.col("tree_id").alias("tree_a"), "split_key", F.col("support").alias("sa"))
    b = splits.select(F.col("tree_id").alias("tree_b"), F.col("split_key").alias("k2"), F.col("support").alias("sb"))
    common = a.join(b, (F.col("split_key") == F.col("k2")) & (F.col("tree_a") < F.col("tree_b")))
    less = common.groupBy("tree_a", "tree_b").agg(F.sum(F.abs(F.col("sa") - F.col("sb")) - F.col("sa") - F.col("sb")).alias("less"))
    total = splits.groupBy("tree_id").agg(F.sum("support").alias("total"))
    x = total.select(F.col("tree_id").alias("x"), F.col("total").alias("tx"))
    y = total.select(F.col("tree_id").alias("y"), F.col("total").alias("ty"))
    pairs = x.join(y, F.col("x") < F.col("y"))
    on = (F.col("x") == F.col("tree_a")) & (F.col("y") == F.col("tree_b"))
    wrf = (F.col("tx") + F.col("ty") + F.coalesce("less", F.lit(0))) / 100.0
    return pairs.join(less, on, "left").select(F.col("x").alias("tree_a"), F.col("y").alias("tree_b"), wrf.alias("wrf"))


def consensus(splits: DataFrame, n_trees: int, rule: str = "MR") -> DataFrame:
    """(split_key, n_trees) of a consensus: MR (more than half), STRICT (all) or T_50 to T_100 (more than that percentage)."""
    if rule == "STRICT":
        return frequencies(splits).where(F.col("n_trees") == n_trees)
    least = n_trees // 2 if rule == "MR" else n_trees * int(rule.removeprefix("T_")) // 100
    return frequencies(splits).where(F.col("n_trees") > least)


def _extended(rows: list[tuple[int, int]], n_trees: int, most: int) -> list[tuple[int, int]]:
    taken: list[tuple[int, int]] = []
    for key, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(taken) == most:
            break
        if n > n_trees // 2 or all(key & k in (0, key, k) for k, _ in taken):
            taken.append((key, n))
    return taken


def extended_consensus(splits: DataFrame, n_trees: int, n_taxa: int, by: list[str] | None = None) -> DataFrame:
    """(by, split_key, n_trees): splits by falling frequency, ties to the smaller key, each taken if it fits those taken before, up to
    n_taxa - 3. One task per group of trees walks its distinct splits, which taxa and trees bound."""
    by = by or []
    counts = splits.groupBy(*by, "split_key").agg(F.count(F.lit(1)).alias("n_trees")).withColumn("all_groups", F.lit(0))
    keys = [*by, "all_groups"]

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        taken = _extended(list(zip(group["split_key"].tolist(), group["n_trees"].tolist(), strict=True)), n_trees, n_taxa - 3)
        out = pd.DataFrame(taken, columns=["split_key", "n_trees"])
        for name, value in zip(by, key, strict=False):
            out.insert(0, name, value)
        return out[[*by, "split_key", "n_trees"]]

    kinds = [f"{c} {splits.schema[c].dataType.simpleString()}" for c in by]
    return counts.groupBy(*keys).applyInPandas(walk, ", ".join([*kinds, "split_key long, n_trees long"]))


def conflicts(reference: DataFrame, counts: DataFrame) -> DataFrame:
    """(split_key, other, n_trees): splits of counts that don't fit a reference split. A reference tree has at most as many splits as
    taxa, so it is the side that is sent."""
    other = counts.select(F.col("split_key").alias("other"), "n_trees")
    return F.broadcast(reference.select("split_key")).join(other, ~compatible(F.col("split_key"), F.col("other"))).select("split_key", "other", "n_trees")


def internode_certainty(reference: DataFrame, counts: DataFrame, n_trees: int) -> DataFrame:
    """(split_key, ic, ica): certainty of each reference split against its most frequent conflict, and against all mutually conflicting
    splits in more than a twentieth of the trees, the first of them always."""
    own = reference.join(counts.select("split_key", F.col("n_trees").alias("n")), "split_key", "left").fillna(0, ["n"])
    against = conflicts(reference, counts).groupBy("split_key").agg(F.collect_list(F.struct("n_trees", "other")).alias("c"))
    rows = own.join(against, "split_key", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n, c in zip(batch["split_key"], batch["n"], batch["c"], strict=True):
                found = [] if c is None else sorted(((r["n_trees"], r["other"]) for r in c), key=lambda r: (-r[0], r[1]))
                chosen: list[tuple[int, int]] = []
                for m, other in found:
                    fits_none = all(other & k not in (0, other, k) for _, k in chosen)
                    if not chosen or (m > n_trees // 20 and fits_none):
                        chosen.append((m, other))
                out.append((key, _certainty([n] + [m for m, _ in chosen[:1]]), _certainty([n] + [m for m, _ in chosen])))
            yield pd.DataFrame(out, columns=["split_key", "ic", "ica"])

    return rows.mapInPandas(judge, "split_key long, ic double, ica double")


def _certainty(counts: list[int]) -> float:
    """1 plus the shares' sum of p log p, to the base of their number; negative if another split is more frequent than the first."""
    import math

    if len(counts) == 1:
        return 1.0
    total = sum(counts)
    value = 1 + sum(c / total * math.log(c / total, len(counts)) for c in counts if c)
    return -value if max(counts[1:]) > counts[0] else value


def split_correlation(first: DataFrame, n_first: int, second: DataFrame, n_second: int) -> DataFrame:
    """One row: r, Pearson's correlation of the splits' frequencies in two tree sets; 1 if all are equal, 0 if one doesn't vary."""
    a = frequencies(first).select("split_key", (F.col("n_trees") / n_first).alias("fa"))
    b = frequencies(second).select(F.col("split_key").alias("k2"), (F.col("n_trees") / n_second).alias("fb"))
    both = a.join(b, F.col("split_key") == F.col("k2"), "full").select(F.coalesce("fa", F.lit(0.0)).alias("x"), F.coalesce("fb", F.lit(0.0)).alias("y"))
    sums = both.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    r = F.when(F.col("gap") == 0, 1.0).when((F.col("vx") == 0) | (F.col("vy") == 0), 0.0).otherwise(F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return sums.select(r.alias("r"))


def bootstop_frequency(splits: DataFrame, n_trees: int, halves: DataFrame) -> DataFrame:
    """halves: (perm, tree_id, half), half 0 or 1. (perm, r): the correlation of the split counts of a permutation's halves. Trees have
    converged when nearly all permutations reach 0.99 (converged())."""
    joined = halves.join(splits, "tree_id").groupBy("perm", "split_key").agg(
        F.sum(F.when(F.col("half") == 0, 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("half") == 1, 1).otherwise(0)).alias("y")
    )
    sums = joined.groupBy("perm").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    r = F.when(F.col("gap") == 0, 1.0).when((F.col("vx") == 0) | (F.col("vy") == 0), 0.0).otherwise(F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return sums.select("perm", r.alias("r"))


def converged(correlations: DataFrame, least: float = 0.99) -> DataFrame:
    """One row: passes, mean_r, converged."""
    n = correlations.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("r") >= least).cast("int")).alias("passes"), F.avg("r").alias("mean_r"))
    enough = (F.col("passes") >= F.col("n") - F.round(F.col("n") / 100)) & (F.col("mean_r") >= least)
    return n.select("passes", "mean_r", enough.alias("converged"))


def bootstop_halves(trees: DataFrame, perms: int = 100) -> DataFrame:
    """(perm, tree_id, half): for each permutation the trees in the order of a hash, dealt to both halves in turn. Each permutation
    orders all trees for itself."""
    from pyspark.sql import Window

    p = trees.select("tree_id", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))).alias("perm"))
    order = Window.partitionBy("perm").orderBy(F.md5(F.concat_ws("-", "perm", "tree_id")), "tree_id")
    return p.select("perm", "tree_id", ((F.row_number().over(order) - 1) % 2).alias("half"))


def restricted(splits: DataFrame, mask: int) -> DataFrame:
    """(tree_id, split_key): splits on the taxa of a mask only, without those that become trivial; keys are normalised to the mask's
    first taxon."""
    inside = F.col("split_key").bitwiseAND(mask)
    low = mask & -mask
    side = F.when(inside.bitwiseAND(low) != 0, F.lit(mask) - inside).otherwise(inside)
    inner = (F.bit_count("split_key") >= 2) & (F.bit_count("split_key") <= mask.bit_count() - 2)
    return splits.select("tree_id", side.alias("split_key")).where(inner).distinct()


def plausibility(large: DataFrame, small: DataFrame, small_taxa: DataFrame) -> DataFrame:
    """Relative Robinson-Foulds distance of many small trees to what a large tree induces on their taxa.

    large: (split_key) of one tree; small: (tree_id, split_key) with keys normalised to each tree's least taxon; small_taxa: (tree_id, mask).
    Trees with one set of taxa share the projection of the large tree; trees without inner splits are left out.
    """
    masks = small_taxa.select("mask").distinct()
    projected = masks.join(F.broadcast(large.select(F.col("split_key").alias("k"))), F.lit(True))
    inside = F.col("k").bitwiseAND(F.col("mask"))
    low = F.col("mask").bitwiseAND(-F.col("mask"))
    side = F.when(inside.bitwiseAND(low) != 0, F.col("mask") - inside).otherwise(inside)
    induced = projected.select("mask", side.alias("key")).where((F.bit_count("key") >= 2) & (F.bit_count("key") <= F.bit_count("mask") - 2)).distinct()
    own = small.join(small_taxa, "tree_id").select("tree_id", "mask", F.col("split_key").alias("key"))
    n_own = own.groupBy("tree_id", "mask").agg(F.count(F.lit(1)).alias("n_own"))
    n_induced = induced.groupBy("mask").agg(F.count(F.lit(1)).alias("n_induced"))
    shared = own.join(induced, ["mask", "key"]).groupBy("tree_id").agg(F.count(F.lit(1)).alias("shared"))
    found = n_own.join(n_induced, "mask", "left").join(shared, "tree_id", "left").fillna(0, ["n_induced", "shared"])
    rf = F.col("n_own") + F.col("n_induced") - 2 * F.col("shared")
    return found.select("tree_id", rf.cast("long").alias("rf"), (rf / (2 * F.col("n_own"))).alias("relative_rf"))


def rogue_gains(splits: DataFrame, n_trees: int, n_taxa: int) -> DataFrame:
    """(taxon, gain): for each taxon the number of majority splits after its removal less the number before without those that its removal
    makes trivial: the first step of a greedy search for taxa that hide consensus. Removal merges splits that differ in the taxon alone."""
    taxa = splits.sparkSession.range(1, n_taxa).select(F.col("id").cast("int").alias("taxon"))
    bit = F.expr("shiftleft(1L, taxon)")
    full = (1 << n_taxa) - 1
    without = splits.crossJoin(F.broadcast(taxa)).select("tree_id", "taxon", F.col("split_key").bitwiseAND(F.lit(full) - bit).alias("key"))
    inner = without.where((F.bit_count("key") >= 2) & (F.bit_count("key") <= n_taxa - 3)).distinct()
    after = inner.groupBy("taxon", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n_trees // 2).groupBy("taxon").agg(F.count(F.lit(1)).alias("after"))
    before = consensus(splits, n_trees).agg(F.count(F.lit(1)).alias("before"))
    found = taxa.join(after, "taxon", "left").crossJoin(F.broadcast(before))
    return found.select("taxon", (F.coalesce("after", F.lit(0)) - F.col("before")).alias("gain"))


def topologies(splits: DataFrame) -> DataFrame:
    """(tree_id, topology): a digest of the tree's splits, equal for equal topologies. A tree's splits are fewer than its taxa."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_set("split_key")), lambda k: k.cast("string")), ",")
    return splits.groupBy("tree_id").agg(F.md5(keys.cast("binary")).alias("topology"))


def distinct_topologies(splits: DataFrame) -> DataFrame:
    """(topology, n_trees, first_tree) of all trees."""
    return topologies(splits).groupBy("topology").agg(F.count(F.lit(1)).alias("n_trees"), F.min("tree_id").alias("first_tree"))


def monophyletic(splits: DataFrame, groups: DataFrame, full: int) -> DataFrame:
    """groups: (group_id, mask of its taxa). (group_id, n_trees): in how many trees the group has a branch of its own; full is the mask
    of all taxa. Groups that are so nowhere have no row."""
    side = F.when(F.col("mask").bitwiseAND(1) != 0, F.lit(full) - F.col("mask")).otherwise(F.col("mask"))
    keys = groups.select("group_id", side.alias("key"))
    per_split = splits.select("tree_id", "split_key").distinct().groupBy("split_key").agg(F.count(F.lit(1)).alias("n_trees"))
    return keys.join(per_split, F.col("key") == F.col("split_key")).select("group_id", "n_trees")


def admissible(splits: DataFrame, constraint: list[int]) -> DataFrame:
    """(tree_id, admissible): whether none of the tree's splits contradicts one of the constraint's, of which there are fewer than taxa."""
    key = F.col("split_key")
    fits = lambda c: (key.bitwiseAND(c) == 0) | (key.bitwiseAND(c) == key) | (key.bitwiseAND(c) == c)
    every = F.forall(F.array(*[F.lit(c).cast("long") for c in constraint]), fits)
    return splits.groupBy("tree_id").agg(F.bool_and(every).alias("admissible"))
