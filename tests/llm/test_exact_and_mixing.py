import hashlib
import random
import re
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clademill.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


EDGES = [
    (1, "a  b\tc", "x"), (2, "a b c", "x"), (3, None, "y"), (4, "", "y"), (5, " ", "y"), (6, "A b c", None),
    (2, "a b c", "x"), (7, "word " * 50_000, "z"), (8, "word\n" * 50_000, "z"), (9, "a b c", "x"), (None, "a b c", "x"),
    (None, "alone", "x"),
]


def expected_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t, _ in rows:
        ids = [k for k in groups[norm(t)] if k is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(map(repr, out))


def as_rows(df):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


def test_edges_against_brute_force(spark):
    assert as_rows(exact_dedup.exact_dedup(docs(spark, EDGES))) == expected_groups(EDGES)


def test_one_digest_for_two_texts_keeps_them_apart(spark):
    """A digest of one digit collides all the time; whole texts still decide."""
    some = [(i, f"text {i % 40}", "s") for i in range(300)]
    clash = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    assert as_rows(exact_dedup.exact_dedup(docs(spark, some), digest=clash)) == expected_groups(some)


def test_hot_group_and_clashing_columns(spark):
    some = [(i, "copy" if i % 3 else f"own {i}", "s") for i in range(3000)]
    wide = docs(spark, some)
    for name in ("id", "body", "digest", "salt", "n", "keep_id", "d", "texts", "text_sha256", "kept"):
        wide = wide.withColumn(name, F.lit(1))
    assert as_rows(exact_dedup.exact_dedup(wide)) == expected_groups(some)


def test_drop_copies(spark):
    left = exact_dedup.drop_copies(docs(spark, EDGES)).collect()
    assert sorted((r["doc_id"], r["text"][:5] if r["text"] else r["text"]) for r in left if r["doc_id"] is not None) == [
        (1, "a  b\t"), (3, None), (5, " "), (6, "A b c"), (7, "word "), (9, "a b c"),
    ]
    assert [r["text"] for r in left if r["doc_id"] is None] == ["alone"]


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, exact_dedup.drop_copies, mixing.mix, mixing.mixed])
def test_empty_table(spark, run):
    assert run(docs(spark, [(1, "a", "b")]).where("doc_id = 0")).collect() == []


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while True:
        per = left / max(1e-12, sum(weight[s] for s in open_))
        over = [s for s in open_ if per * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: per * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    some = [(i, "w " * rng.randint(0, 60), rng.choice("aaaabbc") if i % 50 else None) for i in range(4000)]
    got = mixing.mix(docs(spark, some)).toPandas()
    sizes = defaultdict(int)
    for _, t, s in some:
        sizes[s] += t.count("w")
    source = {i: s for i, _, s in some}
    got["source"] = got["doc_id"].map(source).fillna("none")
    want = {s if s is not None else "none": v for s, v in brute_targets(sizes).items()}
    for s, part in got.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= 60
    assert (got["taken"] <= 3 * got["size"]).all()
    assert (got["taken"] == got["size"] * got["copies"]).all()
    again = mixing.mix(docs(spark, some[::-1]).repartition(5)).toPandas()
    pd.testing.assert_frame_equal(
        got.drop(columns="source").sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True)
    )


def test_mixed_repeats_documents_as_mix_says(spark):
    wide = docs(spark, EDGES).withColumn("copies", F.lit("own")).withColumn("digits", F.lit("own")).withColumn("s", F.lit("own"))
    copies = mixing.mix(wide).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    found = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {r["doc_id"]: r["n"] for r in copies if r["n"]}


def test_mixed_native_plan(spark):
    for df in (mixing.mix(docs(spark, EDGES)), exact_dedup.exact_dedup(docs(spark, EDGES))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
