"""Likelihoods: of fixed trees over blocks of patterns, of pairs, quartets and placements."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Model
from ..sources.trees import Node, masks, parse, unrooted, write

#: Shortest and longest branches: Fixed values, exp(-t) lies between 1e-15 and 1 - 1e-6.
SHORTEST, LONGEST = 1e-6, 34.5
_RESCALE = 2.0**256
#: Numbers (query, pattern, category, state) of a block of placements.
_AT_ONCE = 1 << 17


def tip_vectors(codes: np.ndarray, states: int = 4) -> np.ndarray:
    """(patterns, states): 1 for the states of each mask."""
    return ((codes[:, None] >> np.arange(states)) & 1).astype(float)


def conditional(node: Node, tips: dict[str, np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods below a node (pattern, category, state), and how often each pattern was scaled up."""
    below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _, n in masks(node, _Any()):
        if not n.children:
            v = tips[n.name]
            below[id(n)] = (np.repeat(v[:, None, :], len(model.rates), 1), np.zeros(len(v), np.int64))
            continue
        out = scaled = None
        for c in n.children:
            v, s = below.pop(id(c))
            t = min(max(c.length if c.length is not None else 0.1, SHORTEST), LONGEST)
            moved = np.einsum("cij,pcj->pci", model.transition(t), v)
            out, scaled = (moved, s) if out is None else (out * moved, scaled + s)
        low = out.max((1, 2)) < 1 / _RESCALE
        if low.any():
            out[low] *= _RESCALE
            scaled = scaled + low
        below[id(n)] = (out, scaled)
    return below[id(node)]


class _Any(dict):
    """Any name is taxon 1: the order of nodes is all that's asked for."""

    def __contains__(self, name: object) -> bool:
        return True

    def __missing__(self, name: str) -> int:
        return 1


def log_likelihoods(node: Node, tips: dict[str, np.ndarray], model: Model) -> np.ndarray:
    """Of every pattern, with the root at any node."""
    v, scaled = conditional(node, tips, model)
    site = np.einsum("pci,i->p", v, model.freqs) / len(model.rates)
    if model.invariant:
        same = np.ones_like(next(iter(tips.values())))
        for t in tips.values():
            same = same * t
        constant = same @ model.freqs
        site = (1 - model.invariant) * site + model.invariant * constant * np.where(scaled > 0, 0, 1)
    return np.log(np.maximum(site, 1e-300)) - scaled * np.log(_RESCALE)


def site_likelihoods(patterns: DataFrame, trees: DataFrame, names: list[str], model: Model) -> DataFrame:
    """patterns: (pattern_id, codes by order of names, weight); trees: (tree_id, newick). (tree_id, pattern_id, weight, ll). Patterns stay
    where they are; the trees of a call are broadcast in the function and every batch of patterns is computed at once."""
    shared = patterns.sparkSession.sparkContext.broadcast([(r["tree_id"], r["newick"]) for r in trees.collect()])  # a few trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = [(i, unrooted(parse(n))) for i, n in shared.value]
        for batch in batches:
            if not len(batch):
                continue
            codes = np.stack([np.asarray(c, np.int64) for c in batch["codes"]], 1)
            tips = {name: tip_vectors(c) for name, c in zip(names, codes, strict=True)}
            for i, tree in parsed:
                yield pd.DataFrame({"tree_id": i, "pattern_id": batch["pattern_id"], "weight": batch["weight"], "ll": log_likelihoods(tree, tips, model)})

    return patterns.select("pattern_id", "codes", "weight").mapInPandas(run, "tree_id long, pattern_id long, weight long, ll double")


def jukes_cantor_site(codes: list[Column], branches: list[float]) -> Column:
    """The likelihood of a site on ((1,2),(3,4)) as one expression: branches of the four tips, then of the inner edge. Codes are
    masks of A, C, G and T."""
    def row(code: Column, t: float) -> list[Column]:
        same, other = 0.25 + 0.75 * math.exp(-4 * t / 3), 0.25 - 0.25 * math.exp(-4 * t / 3)
        bits = [F.shiftright(code, s).bitwiseAND(1).cast("double") for s in range(4)]
        every = bits[0] + bits[1] + bits[2] + bits[3]
        return [F.lit(other) * every + F.lit(same - other) * b for b in bits]

    a, b, c, d = (row(x, t) for x, t in zip(codes, branches, strict=False))
    left, right = [x * y for x, y in zip(a, b, strict=True)], [x * y for x, y in zip(c, d, strict=True)]
    t = branches[4]
    same, other = 0.25 + 0.75 * math.exp(-4 * t / 3), 0.25 - 0.25 * math.exp(-4 * t / 3)
    total = right[0] + right[1] + right[2] + right[3]
    terms = [lx * (F.lit(other) * total + F.lit(same - other) * rx) for lx, rx in zip(left, right, strict=True)]
    return 0.25 * (terms[0] + terms[1] + terms[2] + terms[3])


def optimised(tree: Node, tips: dict[str, np.ndarray], weight: np.ndarray, model: Model) -> tuple[float, Node]:
    """The tree with each branch in turn at its best length (golden sections on the logarithm), until a round gains less than 0.01. Rounds
    end, as no log likelihood is above 0."""
    every = [n for _, n in masks(tree, _Any()) if n is not tree]
    for n in every:
        n.length = min(max(n.length if n.length is not None else 0.1, SHORTEST), LONGEST)
    value = lambda: float(weight @ log_likelihoods(tree, tips, model))
    best = value()
    before = -math.inf
    while best - before >= 0.01:
        before = best
        for n in every:
            best = max(best, _line(n, value))
    return best, tree


def _line(n: Node, value, longest: float = LONGEST) -> float:
    """The best value over lengths of a branch up to longest, both ends and the present length included."""
    ratio, kept, start = (5**0.5 - 1) / 2, n.length, value()
    ends = (SHORTEST, longest)
    low, high = np.log(ends)

    def at(x: float) -> float:
        n.length = float(np.exp(x))
        return value()

    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = at(a), at(b)
    while high - low > 0.02:
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = at(b)
        else:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = at(a)
    found, length = at((low + high) / 2), n.length
    for n.length in ends:
        if (new := value()) > found:
            found, length = new, n.length
    if found < start:
        found, length = start, kept
    n.length = length
    return found


def evaluate_trees(patterns: DataFrame, trees: DataFrame, names: list[str], model: Model) -> DataFrame:
    """(tree_id, lnl, newick): each tree with branch lengths at their best. A tree is a task's row; the patterns of the one alignment go
    to all tasks."""
    rows = patterns.select("codes", "weight").collect()  # distinct columns of one alignment
    codes = np.array([r["codes"] for r in rows], np.int64).T
    weight = np.array([r["weight"] for r in rows], float)
    shared = patterns.sparkSession.sparkContext.broadcast((codes, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, w = shared.value
        tips = {name: tip_vectors(x) for name, x in zip(names, c, strict=True)}
        for batch in batches:
            out = []
            for i, newick in zip(batch["tree_id"], batch["newick"], strict=True):
                lnl, tree = optimised(unrooted(parse(newick)), tips, w, model)
                out.append((i, lnl, write(tree)))
            yield pd.DataFrame(out, columns=["tree_id", "lnl", "newick"])

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, lnl double, newick string")


def place(patterns: DataFrame, queries: DataFrame, newick: str, names: list[str], model: Model) -> DataFrame:
    """(query_id, edge, lnl, distal, pendant): each query at each edge of a reference tree (numbered in post order), the new branch and both
    parts of the edge at their best lengths in turn. distal is the part below the query, scaled so that both parts make up the edge again.
    patterns: (pattern_id, codes, weight); queries: (query_id, codes by pattern_id). Queries are rows, spread over tasks, and each edge takes
    as many of them at once as _AT_ONCE allows."""
    rows = patterns.orderBy("pattern_id").select("codes", "weight").collect()  # one reference alignment
    codes = np.array([r["codes"] for r in rows], np.int64).T
    weight = np.array([r["weight"] for r in rows], float)
    shared = patterns.sparkSession.sparkContext.broadcast((codes, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, w = shared.value
        tips = {name: tip_vectors(x) for name, x in zip(names, c, strict=True)}
        tree = unrooted(parse(newick))
        edges = [(*_sides(tree, n, tips, model), n.length if n.length is not None else 0.1) for _, n in masks(tree, _Any()) if n is not tree]
        same = np.prod(list(tips.values()), 0)
        some = max(1, _AT_ONCE // (edges[0][0][0].size or 1))
        for batch in batches:
            for k in range(0, len(batch), some):
                q = batch["query_id"].to_numpy()[k : k + some]
                own = tip_vectors(np.stack([np.asarray(x, np.int64) for x in batch["codes"][k : k + some]]).ravel()).reshape(len(q), len(w), -1)
                for edge, (below, above, length) in enumerate(edges):
                    lnl, lengths = _insertions(below, above, own, length, w, model, same)
                    low, high, pendant = lengths.T
                    yield pd.DataFrame({"query_id": q, "edge": edge, "lnl": lnl, "distal": length * low / (low + high), "pendant": pendant})

    # a row is much work, so few files are dealt out
    return queries.select("query_id", "codes").repartition("query_id").mapInPandas(run, "query_id long, edge int, lnl double, distal double, pendant double")


_Side = tuple[np.ndarray, np.ndarray]


def _sides(tree: Node, node: Node, tips: dict[str, np.ndarray], model: Model) -> tuple[_Side, _Side]:
    """conditional() of both ends of the edge above a node, each without the other side."""
    parent = {id(c): n for _, n in masks(tree, _Any()) for c in n.children}

    def above(n: Node) -> Node:
        up = parent[id(n)]
        others = [c for c in up.children if c is not n]
        return Node("", up.length, [*others, above(up)] if up is not tree else others)

    return conditional(node, tips, model), conditional(above(node), tips, model)


def _insertion(
    below: _Side, above: _Side, tip: np.ndarray, length: float, weight: np.ndarray, model: Model, same: np.ndarray
) -> tuple[float, tuple[float, float, float]]:
    """_insertions() of one tip."""
    lnl, lengths = _insertions(below, above, tip[None], length, weight, model, same)
    return float(lnl[0]), tuple(lengths[0].tolist())


def _insertions(
    below: _Side, above: _Side, tips: np.ndarray, length: float, weight: np.ndarray, model: Model, same: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The log likelihood with each of some tips (query, pattern, state) at an edge, and the lengths below, above and of the tip's branch. Each
    has rounds until one gains less than 0.01. same: states that are possible for all tips of the tree at each pattern."""
    half = min(max(length / 2, SHORTEST), LONGEST)
    lengths, best = np.tile([half, half, 0.1], (len(tips), 1)), np.full(len(tips), -math.inf)
    scaled = below[1] + above[1]
    lost = float(weight @ scaled) * np.log(_RESCALE)
    constant = (same * tips) @ model.freqs * np.where(scaled > 0, 0, 1)
    turned = [(v @ model.right.T)[None] for v in (below[0], above[0])] + [(tips @ model.right.T)[:, :, None]]
    decay = lambda t: np.exp(np.multiply.outer(t, np.multiply.outer(model.rates, model.values)))
    active = np.arange(len(tips))
    while len(active):
        before, t = best[active], lengths[active]
        vectors, fixed = [*turned[:2], turned[2][active]], constant[active]
        moved = lambda j: (decay(t[:, j])[:, None] * vectors[j]) @ model.left.T  # noqa: B023, E731
        for k in (2, 0, 1):
            i, j = (x for x in range(3) if x != k)
            # of every pattern: what the branch's exponentials are multiplied with
            terms = ((moved(i) * moved(j) * model.freqs) @ model.left * vectors[k]).reshape(len(active), len(weight), -1)

            def value(x: np.ndarray, terms=terms, fixed=fixed) -> np.ndarray:
                site = (terms @ decay(x).reshape(len(x), -1, 1))[..., 0] / len(model.rates)
                if model.invariant:
                    site = (1 - model.invariant) * site + model.invariant * fixed
                return np.log(np.maximum(site, 1e-300)) @ weight - lost

            found, t[:, k] = _lines(t[:, k], value)
            best[active] = np.maximum(best[active], found)
        lengths[active] = t
        active = active[best[active] - before >= 0.01]
    return best, lengths


def _lines(kept: np.ndarray, value) -> tuple[np.ndarray, np.ndarray]:
    """_line() for many branches at once: the best values, and the lengths that have them."""
    ratio, start = (5**0.5 - 1) / 2, value(kept)
    low, high = np.full(len(kept), np.log(SHORTEST)), np.full(len(kept), np.log(LONGEST))
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = value(np.exp(a)), value(np.exp(b))
    while (high - low).max(initial=0) > 0.02:
        up = fa < fb
        low, high = np.where(up, a, low), np.where(up, high, b)
        new = np.where(up, low + ratio * (high - low), high - ratio * (high - low))
        f = value(np.exp(new))
        a, fa, b, fb = np.where(up, b, new), np.where(up, fb, f), np.where(up, new, a), np.where(up, f, fa)
    length = np.exp((low + high) / 2)
    found = value(length)
    for end in (SHORTEST, LONGEST):
        new = value(np.full(len(kept), end))
        found, length = np.where(new > found, new, found), np.where(new > found, end, length)
    return np.where(found < start, start, found), np.where(found < start, kept, length)


def pair_distances(cell: DataFrame) -> DataFrame:
    """cell: (taxon_id, site, code). (taxon_a, taxon_b, sites, differ, distance) of all pairs a < b: Jukes-Cantor distances by the share of
    determined sites that differ, null where it is 3/4 or more. Pairs are rows of the result; sites meet by equality."""
    one = cell.where(F.bit_count("code") == 1)
    a = one.select(F.col("taxon_id").alias("taxon_a"), "site", F.col("code").alias("ca"))
    b = one.select(F.col("taxon_id").alias("taxon_b"), F.col("site").alias("s2"), F.col("code").alias("cb"))
    met = a.join(b, (F.col("site") == F.col("s2")) & (F.col("taxon_a") < F.col("taxon_b")))
    n = met.groupBy("taxon_a", "taxon_b").agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("ca") != F.col("cb")).alias("differ"))
    p = F.col("differ") / F.col("sites")
    return n.select("*", F.when(p < 0.75, -0.75 * F.log(1 - 4 * p / 3)).alias("distance"))


def quartets(n_taxa: int, spark) -> DataFrame:
    """(t1, t2, t3, t4): all quartets t1 < t2 < t3 < t4, each range starting after the one before."""
    q = spark.range(1, n_taxa - 2).select(F.col("id").cast("int").alias("t1"))
    for k in (2, 3, 4):
        q = q.select("*", F.explode(F.sequence(F.col(f"t{k - 1}") + 1, F.lit(n_taxa - 4 + k))).alias(f"t{k}"))
    return q


def quartet_scores(patterns: DataFrame, n_taxa: int) -> DataFrame:
    """(t1, t2, t3, t4, s12, s13, s14): for each quartet the weight of patterns that favour 12|34, 13|24 and 14|23: two pairs of equal states.
    patterns: (codes, weight). Pattern blocks are counted where they are."""
    q = quartets(n_taxa, patterns.sparkSession)
    a, b, c, d = (F.element_at("codes", F.col(f"t{k}")) for k in (1, 2, 3, 4))
    pick = lambda x, y, u, v: F.coalesce(F.sum(F.when((x == y) & (u == v) & (x != u), F.col("weight"))), F.lit(0)).cast("long")
    met = patterns.select("codes", "weight").crossJoin(F.broadcast(q))
    return met.groupBy("t1", "t2", "t3", "t4").agg(pick(a, b, c, d).alias("s12"), pick(a, c, b, d).alias("s13"), pick(a, d, b, c).alias("s14"))


def quartet_likelihoods(patterns: DataFrame, n_taxa: int, model: Model) -> DataFrame:
    """(t1, t2, t3, t4, lnl12, lnl13, lnl14): the three topologies of each quartet with branches at their best. A quartet is a task's row."""
    rows = patterns.select("codes", "weight").collect()  # distinct columns of one alignment
    codes, weight = np.array([r["codes"] for r in rows], np.int64).T, np.array([r["weight"] for r in rows], float)
    shared = patterns.sparkSession.sparkContext.broadcast((codes, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, w = shared.value
        for batch in batches:
            out = []
            for t in batch[["t1", "t2", "t3", "t4"]].itertuples(index=False):
                tips = {str(x): tip_vectors(c[x - 1]) for x in t}
                found = []
                for x, y in ((0, 1), (0, 2), (0, 3)):
                    u, v = sorted({0, 1, 2, 3} - {x, y})
                    found.append(optimised(unrooted(parse(f"({t[x]},{t[y]},({t[u]},{t[v]}));")), tips, w, model)[0])
                out.append((*t, *found))
            yield pd.DataFrame(out, columns=["t1", "t2", "t3", "t4", "lnl12", "lnl13", "lnl14"])

    every = quartets(n_taxa, patterns.sparkSession)
    return every.repartition(patterns.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "t1 int, t2 int, t3 int, t4 int, lnl12 double, lnl13 double, lnl14 double")


def neighbours(tree: Node) -> Iterator[str]:
    """Newick of the trees that one exchange across an inner edge makes."""
    inner = [(p, n) for _, p in masks(tree, _Any()) for n in p.children if n.children]
    for p, n in inner:
        for c in n.children[:2]:
            other = next(x for x in p.children if x is not n)
            i, j = n.children.index(c), p.children.index(other)
            n.children[i], p.children[j] = other, c
            yield write(tree)
            n.children[i], p.children[j] = c, other


def search(patterns: DataFrame, starts: DataFrame, names: list[str], model: Model) -> DataFrame:
    """(tree_id, lnl, newick): hill climbing by exchanges across inner edges from each start tree, until none is better. In every step all
    neighbours of all searches are rows that one job evaluates."""
    spark = patterns.sparkSession
    current = {r["tree_id"]: (r["lnl"], r["newick"]) for r in evaluate_trees(patterns, starts, names, model).collect()}  # a row per start
    active = set(current)
    while active:
        rows = [(i, n) for i in sorted(active) for n in neighbours(unrooted(parse(current[i][1])))]
        if not rows:
            break
        tried = spark.createDataFrame(rows, "tree_id long, newick string").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
        best = evaluate_trees(patterns, tried, names, model).groupBy("tree_id").agg(F.max(F.struct("lnl", "newick")).alias("b"))
        better = {r["tree_id"]: (r["b"]["lnl"], r["b"]["newick"]) for r in best.collect() if r["b"]["lnl"] > current[r["tree_id"]][0] + 0.01}
        current |= better
        active = set(better)
    return spark.createDataFrame([(i, *v) for i, v in sorted(current.items())], "tree_id long, lnl double, newick string")
