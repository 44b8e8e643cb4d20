"""Parsimony: Fitch scores of fixed trees as column expressions, and placement and stepwise addition on top of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tree = int | tuple["Tree", ...]


def fitch(patterns: DataFrame, tree: Tree, column: str = "codes") -> DataFrame:
    """patterns: (codes array of masks by taxon, weight). Adds changes: the least number of state changes on the tree, whose leaves are
    taxon numbers from 1. Each inner node is a projection, so that the expression grows with the tree alone."""
    out = patterns.withColumn("changes", F.lit(0))
    made = 0

    def visit(node: Tree):
        nonlocal out, made
        if isinstance(node, int):
            return F.element_at(column, node)
        here = visit(node[0])
        for child in node[1:]:
            other = visit(child)
            name, both = f"set_{made}", here.bitwiseAND(other)
            made += 1
            out = out.withColumn(name, F.when(both != 0, both).otherwise(here.bitwiseOR(other))).withColumn("changes", F.col("changes") + (both == 0).cast("int"))
            here = F.col(name)
        return here

    visit(tree)
    return out.drop(*[f"set_{k}" for k in range(made)])


def score(patterns: DataFrame, tree: Tree) -> DataFrame:
    """One row: the tree's parsimony score over weighted patterns."""
    return fitch(patterns, tree).agg(F.sum(F.col("weight") * F.col("changes")).cast("long").alias("score"))


def tree_scores(patterns: DataFrame, trees: DataFrame) -> DataFrame:
    """trees: (tree_id, parents array<int>): parent of each node by node number, tips first (0 to n - 1, -1 for the root), children numbered
    before parents. (tree_id, score). Blocks of patterns meet all trees; each task adds up its blocks before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree_id, parents, codes, weight in zip(batch["tree_id"], batch["parents"], batch["block"], batch["weights"], strict=True):
                tip = np.stack([np.asarray(c, np.int64) for c in codes], 1)
                out.append((tree_id, int(np.asarray(weight) @ fitch_changes(tip, np.asarray(parents)))))
            yield pd.DataFrame(out, columns=["tree_id", "score"])

    blocks = patterns.groupBy(F.pmod(F.xxhash64("codes"), F.lit(64)).alias("b")).agg(F.collect_list("codes").alias("block"), F.collect_list("weight").alias("weights"))
    met = blocks.select("block", "weights").join(F.broadcast(trees))
    kind = trees.schema["tree_id"].dataType.simpleString()
    return met.select("tree_id", "parents", "block", "weights").mapInPandas(run, f"tree_id {kind}, score long").groupBy("tree_id").agg(F.sum("score").alias("score"))


def fitch_changes(tip: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Changes at every pattern; tip: (taxa, patterns) masks."""
    sets: list[np.ndarray | None] = [*tip, *[None] * (len(parents) - len(tip))]
    changes = np.zeros(tip.shape[1], np.int64)
    for k, p in enumerate(parents):
        if p < 0:
            continue
        if sets[p] is None:
            sets[p] = sets[k]
        else:
            both = sets[p] & sets[k]
            changes += both == 0
            sets[p] = np.where(both == 0, sets[p] | sets[k], both)
    return changes


def stepwise(patterns: DataFrame, n_taxa: int, seeds: DataFrame) -> DataFrame:
    """seeds: (seed). (seed, score, newick): for each seed the taxa are added in a random order, each at the edge that costs least. A seed is a
    task; the patterns of one alignment go to all of them."""
    rows = patterns.select("codes", "weight").collect()  # distinct columns of one alignment, which every search needs whole
    tip = np.array([r["codes"] for r in rows], np.int64).T
    weight = np.array([r["weight"] for r in rows], np.int64)
    shared = patterns.sparkSession.sparkContext.broadcast((tip, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, *_added(*shared.value, n_taxa, int(s))) for s in batch["seed"]]
            yield pd.DataFrame(out, columns=["seed", "score", "newick"])

    return seeds.select(F.col("seed").cast("long").alias("seed")).mapInPandas(run, "seed long, score long, newick string")


def _score_of(tree: Tree, tip: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, int]:
    if isinstance(tree, int):
        return tip[tree - 1], 0
    here, total = _score_of(tree[0], tip, weight)
    for child in tree[1:]:
        other, cost = _score_of(child, tip, weight)
        both = here & other
        total += cost + int(weight @ (both == 0))
        here = np.where(both == 0, here | other, both)
    return here, total


def insertions(tree: Tree, tip: int) -> Iterator[Tree]:
    """The tree with the tip at each of its edges; the root's two sides are one edge, which its first side stands for."""

    def below(node: Tree) -> Iterator[Tree]:
        yield (node, tip)
        if not isinstance(node, int):
            for k, child in enumerate(node):
                for new in below(child):
                    yield (*node[:k], new, *node[k + 1 :])

    for k, child in enumerate(tree):
        for new in below(child):
            yield (*tree[:k], new, *tree[k + 1 :])


def _added(tip: np.ndarray, weight: np.ndarray, n_taxa: int, seed: int) -> tuple[int, str]:
    order = (np.random.default_rng(seed).permutation(n_taxa) + 1).tolist()
    tree: Tree = tuple(order[:3])
    best = 0
    for t in order[3:]:
        scored = [(_score_of(x, tip, weight)[1], k, x) for k, x in enumerate(insertions(tree, t))]
        best, _, tree = min(scored, key=lambda s: s[:2])
    return best if n_taxa > 3 else _score_of(tree, tip, weight)[1], as_newick(tree)


def as_newick(tree: Tree) -> str:
    text = lambda n: str(n) if isinstance(n, int) else f"({','.join(map(text, n))})"
    return text(tree) + ";"


def place(patterns: DataFrame, queries: DataFrame, tree: Tree) -> DataFrame:
    """queries: (query_id, codes array of masks by pattern order of pattern_id). (query_id, edge, score): the score with each query at each
    edge of the tree. patterns: (pattern_id, codes, weight). Queries are rows; the reference alignment goes to all tasks."""
    rows = patterns.orderBy("pattern_id").select("codes", "weight").collect()  # one reference alignment
    tip = np.array([r["codes"] for r in rows], np.int64).T
    weight = np.array([r["weight"] for r in rows], np.int64)
    shared = patterns.sparkSession.sparkContext.broadcast((tip, weight, list(insertions(tree, len(tip) + 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tips, w, trees = shared.value
        for batch in batches:
            out = []
            for q, codes in zip(batch["query_id"], batch["codes"], strict=True):
                every = np.vstack([tips, np.asarray(codes, np.int64)])
                out += [(q, edge, _score_of(t, every, w)[1]) for edge, t in enumerate(trees)]
            yield pd.DataFrame(out, columns=["query_id", "edge", "score"])

    return queries.select("query_id", "codes").mapInPandas(run, "query_id long, edge int, score long")
