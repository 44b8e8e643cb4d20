import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.functions import rng
from clademill.functions.models import gamma_rates, gtr, jukes_cantor
from clademill.operators import alignment, likelihood, parsimony, splits, statistics
from clademill.sources import text, trees

G2 = ["((A,B),(C,D),(E,F));", "((A,B),(C,D),(E,F));", "((A,B),((C,E),D),F);", "((A,C),(B,D),(E,F));", "(((A,B),C),D,(E,F));"]
TAXA = {n: k + 1 for k, n in enumerate("ABCDEF")}
G1 = {"A": "ACGTACGTAAC-", "B": "ACGTACGTAAC-", "C": "ACGTTCGAAACN", "D": "ACGTTCGAACC-", "E": "ACCTTGGACCTA"}


@pytest.fixture(scope="module")
def tree_splits(spark):
    df = spark.createDataFrame([(k + 1, n) for k, n in enumerate(G2)], "tree_id int, newick string")
    return trees.splits(df, TAXA).select("tree_id", "split_key").cache()


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(k + 1, n, s) for k, (n, s) in enumerate(G1.items())]
    return alignment.cells(spark.createDataFrame(rows, "taxon_id int, name string, seq string"))


def test_golden_splits(tree_splits):
    counts = {r["split_key"]: r["n_trees"] for r in splits.frequencies(tree_splits).collect()}
    assert counts == {60: 4, 48: 4, 12: 2, 28: 1, 20: 1, 58: 1, 10: 1, 56: 1}
    assert {r["tree_id"]: r["count"] for r in tree_splits.groupBy("tree_id").count().collect()} == dict.fromkeys(range(1, 6), 3)
    reference = tree_splits.where("tree_id = 1").select("split_key")
    assert {r["split_key"]: r["support"] for r in splits.support(reference, tree_splits, 5).collect()} == {60: 80, 48: 80, 12: 40}
    assert sorted(r["split_key"] for r in splits.consensus(tree_splits, 5).collect()) == [48, 60]
    assert sorted(r["split_key"] for r in splits.extended_consensus(tree_splits, 5, 6).collect()) == [12, 48, 60]


def test_golden_distances_and_certainty(spark, tree_splits):
    rf = {(r["tree_a"], r["tree_b"]): r["rf"] for r in splits.rf_distances(tree_splits, tree_splits.select("tree_id").distinct()).collect()}
    want = [[0, 0, 4, 4, 2], [0, 0, 4, 4, 2], [4, 4, 0, 6, 4], [4, 4, 6, 0, 4], [2, 2, 4, 4, 0]]
    assert rf == {(a + 1, b + 1): want[a][b] for a in range(5) for b in range(a + 1, 5)}
    ic = splits.internode_certainty(tree_splits.where("tree_id = 1").select("split_key"), splits.frequencies(tree_splits), 5)
    assert {r["split_key"]: round(r["ic"], 6) for r in ic.collect()} == {60: 0.278072, 48: 0.278072, 12: 0.081704}
    text_ = trees.consensus_newick(splits.consensus(tree_splits, 5), list("ABCDEF"), 5).first()["newick"]
    assert text_ == "(A,B,(C,D,(E,F):1.0[80]):1.0[80]);"


def test_plausibility_of_induced_trees(spark, tree_splits):
    large = tree_splits.where("tree_id = 1").select("split_key")
    small = spark.createDataFrame([(1, 0b110000), (2, 0b010100)], "tree_id int, split_key long")
    taxa = spark.createDataFrame([(1, 0b111100), (2, 0b111100)], "tree_id int, mask long")
    got = {r["tree_id"]: (r["rf"], r["relative_rf"]) for r in splits.plausibility(large, small, taxa).collect()}
    assert got == {1: (0, 0.0), 2: (2, 1.0)}


@pytest.mark.parametrize("bad", ["((A,B)", "(A,B));", "(A,Z);", "(A,B); x", "A,B;"])
def test_bad_trees_raise(bad):
    with pytest.raises(trees.TreeError):
        trees.masks(trees.parse(bad), TAXA)


def test_newick_round_trip():
    for n in ["(A:0.5,'b c':1.25,(D,E)x:2.0);", "(('it''s',B),C,D);"]:
        root = trees.parse(n)
        assert trees.write(trees.parse(trees.write(root))) == trees.write(root)
    assert sorted(trees.tips(trees.parse("((A[note],B),'C D');"))) == ["A", "B", "C D"]


def test_golden_alignment(cells):
    assert alignment.patterns(cells).count() == 12
    assert alignment.informative(cells).count() == 7
    p = alignment.patterns(cells).select(F.transform(F.split("pattern", ","), lambda c: c.cast("int")).alias("codes"), "weight")
    assert parsimony.score(p, ((1, 2), (3, 4), 5)).first()["score"] == 8


def test_golden_likelihood_and_root_invariance(spark, cells):
    p = alignment.columns(cells.where("taxon_id <= 4")).select(F.col("site").alias("pattern_id"), "codes", F.lit(1).cast("long").alias("weight"))
    for newick in ("(A:0.1,B:0.1,(C:0.1,D:0.1):0.1);", "((A:0.1,B:0.1):0.1,C:0.1,D:0.1);"):
        one = spark.createDataFrame([(1, newick)], "tree_id long, newick string")
        lnl = statistics.tree_likelihoods(likelihood.site_likelihoods(p, one, list("ABCD"), jukes_cantor())).first()["lnl"]
        assert lnl == pytest.approx(-30.58026722, abs=1e-7)


def test_likelihood_by_enumeration():
    model = gtr([1, 3, 0.5, 2, 4, 1], [0.3, 0.2, 0.1, 0.4], 0.6)
    tree = trees.parse("(1:0.2,2:0.4,(3:0.1,4:0.7):0.3);")
    codes = np.array([[1, 2, 15], [1, 8, 4], [4, 8, 2], [2, 2, 5]])
    tips = {str(k + 1): likelihood.tip_vectors(c) for k, c in enumerate(codes)}
    got = likelihood.log_likelihoods(tree, tips, model)
    for s in range(3):
        total = 0.0
        for c in range(4):
            p = {t: model.transition(t)[c] for t in (0.1, 0.2, 0.3, 0.4, 0.7)}
            for x in range(4):
                for y in range(4):
                    up = (p[0.2][x] @ tips["1"][s]) * (p[0.4][x] @ tips["2"][s])
                    total += 0.25 * model.freqs[x] * up * p[0.3][x, y] * (p[0.1][y] @ tips["3"][s]) * (p[0.7][y] @ tips["4"][s])
        assert got[s] == pytest.approx(np.log(total), rel=1e-10)


def test_gamma_rates_and_transitions():
    for alpha in (0.05, 0.5, 1, 10):
        assert gamma_rates(alpha).mean() == pytest.approx(1) and gamma_rates(alpha, median=True).mean() == pytest.approx(1)
    assert np.allclose(gamma_rates(0.5), [0.03338775, 0.25191592, 0.82026848, 2.89442785])
    model = gtr([1, 3, 0.5, 2, 4, 1], [0.3, 0.2, 0.1, 0.4])
    assert np.allclose(model.transition(0.7).sum(2), 1) and np.allclose(model.transition(0.3)[0] @ model.transition(0.4)[0], model.transition(0.7)[0])


def test_golden_stream(spark):
    got = spark.range(1, 6).select(rng.state(12345, F.col("id")).alias("s"), rng.uniform(12345, F.col("id")).alias("u")).collect()
    assert [r["s"] for r in got] == [3368691941, 3169604001, 3107932973, 4153392969, 2258947253]
    assert [round(r["u"], 10) for r in got] == [0.7843347129, 0.7379809397, 0.7236220345, 0.9670371583, 0.5259521429]
    far = 10**9 + 7
    assert spark.range(far, far + 1).select(rng.state(99, F.col("id")).alias("s")).first()["s"] == 99 * pow(rng.A, far, rng.M) % rng.M


def test_bootstrap_weights_sum_to_sites(spark):
    w = statistics.bootstrap_weights(100, spark.range(7).withColumnRenamed("id", "replicate"), 42)
    assert {r["n"] for r in w.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()} == {100}


def test_distance(spark):
    seq = spark.createDataFrame([(1, "AAAA" * 4), (2, "AAAC" * 4)], "taxon_id int, seq string")
    assert likelihood.pair_distances(alignment.cells(seq)).first()["distance"] == pytest.approx(0.30409883, abs=1e-8)


def test_structure_pairs(spark):
    rows = [(k + 1, c) for k, c in enumerate("((.[)]).(<>)")]
    got = alignment.paired_sites(spark.createDataFrame(rows, "site int, symbol string")).collect()
    assert sorted((r["left"], r["right"]) for r in got) == [(1, 7), (2, 5), (4, 6), (9, 12), (10, 11)]


def test_stepwise_finds_the_best_of_all_trees(spark, cells):
    p = alignment.patterns(cells).select(F.transform(F.split("pattern", ","), lambda c: c.cast("int")).alias("codes"), "weight")
    got = parsimony.stepwise(p, 5, spark.range(4).withColumnRenamed("id", "seed")).collect()
    rows = p.collect()
    tip, weight = np.array([r["codes"] for r in rows]).T, np.array([r["weight"] for r in rows])
    every = [t for four in parsimony.insertions((1, 2, 3), 4) for t in parsimony.insertions(four, 5)]
    assert len(every) == 15
    assert min(r["score"] for r in got) == min(parsimony._score_of(t, tip, weight)[1] for t in every)


def test_text_sources(spark, tmp_path):
    write = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    fasta = text.fasta(spark, write("a.fa", ">one x\nACG\nT\n>two\nac gt\n")).collect()
    assert sorted((r["name"], r["seq"]) for r in fasta) == [("one x", "ACGT"), ("two", "ACGT")]
    phylip = text.phylip(spark, write("a.phy", "2 8\nA ACGT\nB ACGA\n\n TTTT\nT TTA\n")).collect()
    assert sorted((r["taxon_id"], r["name"], r["seq"]) for r in phylip) == [(1, "A", "ACGTTTTT"), (2, "B", "ACGATTTA")]
    parts = text.partitions(spark, write("p.txt", "DNA, g1 = 1-9\\3, 20\nWAG, g2=10-19\n"))
    assert sorted((r["site"], r["part_id"]) for r in alignment.partition_sites(parts).collect()) == [(1, 0), (4, 0), (7, 0), *[(k, 1) for k in range(10, 20)], (20, 0)]
    assert [(r["lo"], r["hi"]) for r in text.exclusions(spark, write("e.txt", "3-9 12 - 15\n")).collect()] == [(3, 9), (12, 15)]
    assert [r["weight"] for r in text.site_weights(spark, write("w.txt", "1 2\n3\n")).orderBy("site").collect()] == [1, 2, 3]
    assert sorted((r["group_id"], r["name"]) for r in text.groups(spark, write("g.txt", "(a,b),(c),(d),(e);")).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
