import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("run", "label", "least"), [(quality.quality, "quality", 0.85), (toxicity.toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, run, label, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(held)).all()
    cut = 0.5 if label == "quality" else 0.7
    assert (got["predicted"] == (got["score"] >= cut)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both["held_out"]]
    y = both[label].to_numpy()
    assert auc(both["score"].to_numpy(), y) >= least
    accuracy = (both["predicted"] == y).mean()
    assert accuracy >= 0.9, accuracy
    if label == "toxic":
        assert both.loc[y == 1, "predicted"].mean() >= 0.8 and both.loc[y == 0, "predicted"].mean() <= 0.02


def toy(spark):
    """Invented prose; toxic texts hold two of three insults, held-out ones only disguised forms."""
    rng = random.Random(1)
    syllables = ["ra", "mo", "ten", "li", "sha", "por", "ven", "du", "kel", "ri", "os", "am"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]
    rows = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            w = rng.choice(["blorfnik", "zumpwad", "grackhole"])
            at = rng.randrange(2, len(w) - 1)
            forms = [w.upper() + "!", " ".join(w), w[:at] + "x" + w[at:], "-".join(w), w[:at] + w[at] + w[at:]] if held(i) else [w, w.title()]
            words[rng.randrange(40)] = rng.choice(forms)
        rows.append((i, " ".join(words) + ".", int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_disguised_insults(spark):
    rows, docs, labels = toy(spark)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [(i, t) for i, t, y in rows if held(i) and got[i] != y]
    assert len(wrong) <= 8, wrong


def test_drop_toxic_keeps_clean_documents(spark):
    rows, docs, labels = toy(spark)
    wide = docs.withColumn("score", F.lit("own")).withColumn("id", F.lit("own")).withColumn("bad_id", F.lit("own"))
    left = toxicity.drop_toxic(wide, labels)
    assert left.columns == wide.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert len([i for i, _, y in rows if y == 0 and i not in ids]) <= 3
    assert len([i for i, _, y in rows if y == 1 and i in ids]) <= 12


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_edges(spark, run):
    some = [(1, "fine words here"), (1, "fine words here"), (2, None), (3, ""), (None, "x"), (4, "w " * 100_000), (5, "é" * 5000), (6, "\n\n \t")]
    docs = spark.createDataFrame(some, "doc_id long, text string").selectExpr("doc_id", "text", "'own' as id", "1 as x", "2 as y", "3 as score", "4 as label_id")
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (99, 1, 1), (4, 1, 1), (6, 0, 0)], [(4, 1, 1)]):
        got = run(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(some) and all(0 <= r["score"] <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert all(len(v) == 1 for v in by.values())
    empty = docs.where("doc_id = 0")
    assert run(empty, spark.createDataFrame([(1, 1, 1)], schema)).collect() == []


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 30))
        y, w = rng.normal(size=n), rng.uniform(0.5, 2, n)
        fit = quality.isotonic(y, w)
        want = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(fit, want)


def test_normal_equations_give_the_ridge_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality.N_STATS))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    train = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(7)
    model = quality.fit(train)
    z = model.features(x)
    penalty = np.full(z.shape[1], quality.RIDGE * len(x))
    penalty[0] = 0
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(penalty + 1e-9), z.T @ y), atol=1e-6)


def test_kernel_is_the_gappy_subsequence_kernel():
    def brute(a, b):
        def features(u):
            out = {}
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    for k in range(j + 1, len(u)):
                        if k - i < toxicity.SPAN:
                            key = u[i] + u[j] + u[k]
                            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1 - toxicity.LETTERS)
            return out

        norm = lambda u: max(1e-9, sum(toxicity.DECAY ** (2 * (k - i + 1 - 3)) for i in range(len(u)) for j in range(i + 1, len(u)) for k in range(j + 1, len(u)) if k - i < toxicity.SPAN)) ** 0.5  # noqa: E731, E501
        x, y = features(a), features(b)
        return sum(v * y.get(k, 0) for k, v in x.items()) / norm(a) / norm(b)

    some = ["abcd", "axbcd", "hello", "h3llo", "helllo", "zzzzzz", "abcdefghijkl"]
    got = toxicity.kernel(some, toxicity.feature_map(some).T)
    assert np.allclose(got, [[brute(a, b) for b in some] for a in some], atol=1e-4)
    assert got[0, 1] > got[0, 2]  # an inserted letter keeps words similar
