"""Branch lengths and searches end at optima, not after a number of steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.functions.models import gtr, jukes_cantor
from clademill.operators import likelihood
from clademill.sources import trees


def test_line_reaches_long_branches():
    for best in (0.3, 20.0, likelihood.LONGEST):
        n = trees.Node("a", 0.1)
        found = likelihood._line(n, lambda n=n, best=best: -((np.log(n.length) - np.log(best)) ** 2))
        assert n.length == pytest.approx(best, rel=0.02) and found == pytest.approx(0, abs=1e-3)


def test_rounds_go_on_while_they_gain(monkeypatch):
    """A ridge over two branches' logarithms, on which rounds gain little each."""

    def ridge(tree, tips, model):
        x, y, _ = (np.log(c.length) for c in tree.children)
        return np.array([-40 * (x - y) ** 2 - 4 * (x + y - 2) ** 2])

    monkeypatch.setattr(likelihood, "log_likelihoods", ridge)
    lnl, tree = likelihood.optimised(trees.parse("(a:0.1,b:0.1,c:0.1);"), {}, np.ones(1), jukes_cantor())
    assert lnl > -0.5 and np.log([c.length for c in tree.children[:2]]) == pytest.approx([1, 1], abs=0.2)


def test_search_ends_where_no_neighbour_is_better(spark, monkeypatch):
    """Trees that stand for numbers: each step leads to the next one, up to 25."""
    number = F.regexp_extract("newick", r"\d+", 0).cast("double")
    monkeypatch.setattr(likelihood, "evaluate_trees", lambda p, t, *_: t.select("tree_id", F.least(number, F.lit(25.0)).alias("lnl"), "newick"))
    monkeypatch.setattr(likelihood, "neighbours", lambda tree: [f"({int(tree.children[0].name) + 1},b,c);"])
    start = spark.createDataFrame([(1, "(0,b,c);")], "tree_id long, newick string")
    assert likelihood.search(start, start, [], jukes_cantor()).first()["lnl"] == 25


@pytest.fixture(scope="module")
def reference():
    rng = np.random.default_rng(3)
    first = 2 ** rng.integers(0, 4, 60)
    change = lambda x, share: np.where(rng.random(60) < share, 2 ** rng.integers(0, 4, 60), x)
    second = change(first, 0.2)
    return {"1": change(first, 0.6), "2": second, "3": change(second, 0.2), "4": change(second, 0.3)}


def test_placement_optimises_three_branches(spark, reference):
    names, newick, model = list("1234"), "(1:1.2,2:0.3,(3:0.3,4:0.3):0.1);", jukes_cantor()
    codes = np.stack([reference[n] for n in names], 1).tolist()
    patterns = spark.createDataFrame([(k, c, 1) for k, c in enumerate(codes)], "pattern_id long, codes array<int>, weight long")
    queries = spark.createDataFrame([(7, reference["1"].tolist())], "query_id long, codes array<int>")
    got = {r["edge"]: r for r in likelihood.place(patterns, queries, newick, names, model).collect()}
    tree = trees.unrooted(trees.parse(newick))
    order = [n for _, n in trees.masks(tree, likelihood._Any()) if n is not tree]
    tips = {n: likelihood.tip_vectors(c) for n, c in reference.items()}
    near = next(k for k, n in enumerate(order) if n.name == "1")
    assert max(got, key=lambda e: got[e]["lnl"]) == near and got[near]["distal"] < 0.01 and got[near]["pendant"] < 0.01
    for edge, node in enumerate(order):
        assert 0 <= got[edge]["distal"] <= node.length
        below, above = likelihood._sides(tree, node, tips, model)
        lnl, (low, high, pendant) = likelihood._insertion(below, above, tips["1"], node.length, np.ones(60), model, np.ones((60, 4)))
        assert lnl == pytest.approx(got[edge]["lnl"], abs=1e-9)
        whole = trees.unrooted(trees.parse(newick))
        parent, here = next((p, c) for _, p in trees.masks(whole, likelihood._Any()) for c in p.children if trees.write(c) == trees.write(node))
        here.length = low
        parent.children[[c is here for c in parent.children].index(True)] = trees.Node("", high, [here, trees.Node("q", pendant)])
        assert lnl == pytest.approx(likelihood.log_likelihoods(whole, {**tips, "q": tips["1"]}, model).sum(), abs=1e-8)


def test_queries_are_placed_together(spark, reference, monkeypatch):
    """Line searches are for blocks of queries: 30 take no more of them than their slowest one, and each gets what it gets alone."""
    model = gtr([1, 4, 0.5, 1, 2, 1], [0.3, 0.2, 0.2, 0.3], 0.7, 0.2)
    tips = {n: likelihood.tip_vectors(c) for n, c in reference.items()}
    tree = trees.unrooted(trees.parse("(1:0.3,2:0.3,(3:0.3,4:0.3):0.1);"))
    node = next(n for _, n in trees.masks(tree, likelihood._Any()) if n.name == "2")
    below, above = likelihood._sides(tree, node, tips, model)
    same, weight = np.prod(list(tips.values()), 0), np.arange(60) % 3 + 1.0
    rng = np.random.default_rng(5)
    codes = np.where(rng.random((30, 60)) < 0.5, reference["2"], rng.integers(1, 16, (30, 60)))
    own = likelihood.tip_vectors(codes.ravel()).reshape(30, 60, 4)
    searches, lines = [], likelihood._lines
    monkeypatch.setattr(likelihood, "_lines", lambda kept, value: searches.append(len(kept)) or lines(kept, value))
    together, lengths = likelihood._insertions(below, above, own, node.length, weight, model, same)
    n = len(searches)
    alone = []
    for k in range(30):
        searches.clear()
        alone.append((likelihood._insertion(below, above, own[k], node.length, weight, model, same)[0], len(searches)))
    assert n == max(x for _, x in alone) and together == pytest.approx([x for x, _ in alone], abs=1e-9)
    # the first one again, by one branch after the other on whole trees
    branches = [trees.Node("2", 0.15), trees.Node("", 0.15), trees.Node("q", 0.1)]
    middle = trees.Node("", branches[1].length, [branches[0], branches[2]])
    others = [c for c in tree.children if c is not node]
    whole, branches[1] = trees.Node("", None, [*others, middle]), middle
    value = lambda: float(weight @ likelihood.log_likelihoods(whole, {**tips, "q": own[0]}, model))
    best, before = value(), -np.inf
    while best - before >= 0.01:
        before = best
        for k in (2, 0, 1):
            best = max(best, likelihood._line(branches[k], value))
    assert together[0] == pytest.approx(best, abs=0.01) and lengths[0] == pytest.approx([b.length for b in branches], rel=0.05)


def test_blocks_of_queries(spark, reference, monkeypatch):
    """Blocks of two queries give each query a row for each edge, the same as one block does."""
    patterns = spark.createDataFrame([(k, [int(reference[n][k]) for n in "1234"], 1) for k in range(60)], "pattern_id long, codes array<int>, weight long")
    rng = np.random.default_rng(6)
    queries = spark.createDataFrame([(q, (2 ** rng.integers(0, 4, 60)).tolist()) for q in range(7)], "query_id long, codes array<int>")
    placed = lambda: sorted(likelihood.place(patterns, queries.coalesce(1), "(1:0.3,2:0.3,(3:0.3,4:0.3):0.1);", list("1234"), jukes_cantor()).select("query_id", "edge", "lnl").collect())
    whole = placed()
    monkeypatch.setattr(likelihood, "_AT_ONCE", 2 * 60 * 4)
    for x, y in zip(whole, placed(), strict=True):
        assert x[:2] == y[:2] and x["lnl"] == pytest.approx(y["lnl"], abs=1e-9)
    assert [x[:2] for x in whole] == [(q, e) for q in range(7) for e in range(5)]
