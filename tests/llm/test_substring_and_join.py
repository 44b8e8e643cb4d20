import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clademill.llm import ngram_join, substring_dedup
from clademill.llm.components import components

SCHEMA = "doc_id long, text string"


def brute_substring(rows, window):
    words = [(i if i is not None else 2**63 - 1, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < n:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(map(repr, out))


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def corpus(rng):
    shared = [prose(rng, 70) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 90))]
        if i % 3 == 0:
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[5][1]) for k in range(30)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "x " * 400), (304, "x " * 300), (303, "x " * 400), (None, rows[3][1]), (7, rows[7][1])]
    rows += [(400, "loop " + "a b " * 100), (401, "a b " * 60)]
    return rows


@pytest.mark.parametrize(("window", "anchor", "bits"), [(50, 16, 30), (50, 16, 8), (10, 4, 30), (50, 50, 30)])
def test_substring_against_brute_force(spark, window, anchor, bits, monkeypatch):
    """A sketch of a few cells lets more windows pass and changes no row."""
    monkeypatch.setattr(substring_dedup, "LEAST", min(bits, substring_dedup.LEAST))
    monkeypatch.setattr(substring_dedup, "BLOCK", min(1 << bits, substring_dedup.BLOCK))
    rows = corpus(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for name in ("id", "tag", "sha", "body", "n_words", "lost_id", "a", "b"):
        df = df.withColumn(name, F.lit("own"))
    out = substring_dedup.substring_dedup(df, window=window, anchor=anchor, largest_bits=bits, with_text=True)
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"])) for r in out.collect())
    assert got == brute_substring(rows, window)


def test_substring_empty_table_and_bad_anchor(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.substring_dedup(df).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(df, window=5, anchor=6)


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(ngram_join.ASCII_LOWER).split()
        n = min(k, len(w))
        sets.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()))
    ids = [i for i, _ in sets]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_corpus(rng):
    rows, n = [], 0
    for _ in range(25):
        base = prose(rng, rng.randint(2, 120), 2000).split()
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            n += 1
    chain = prose(rng, 200, 5000).split()  # each step is near the last, its ends are not near one another
    for step in range(20):
        chain[step * 9] = f"c{step}"
        rows.append((n + step, " ".join(chain)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "one one one one"), (906, "É a b"), (907, "é a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_join_against_brute_force(spark, words, percent):
    rows = near_corpus(random.Random(words))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("id", "n", "cls", "grp", "token", "component", "rep"):
        df = df.withColumn(name, F.lit("own"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, words=words, percent=percent).collect())
    assert got == brute_components(rows, words, percent)


def test_join_edges(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, None), (5, "a b c d"), (1, "x"), (2, "x " * 50_000)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), words=3, percent=90).collect()
    assert sorted(map(repr, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got])) == sorted(
        map(repr, [(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (5, 2, 3), (1, 1, 1), (2, 1, 2)])
    )
    assert ngram_join.ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_of_each_keeps_the_least_id(spark):
    rows = near_corpus(random.Random(9))
    want = sorted({c for _, _, c in brute_components(rows, 5, 80)})
    left = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert left.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in left.collect()) == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5400)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def family(rng, size, words, edits):
    """Copies of one text with random words replaced, some by the same new word."""
    base = prose(rng, words, 5000).split()
    rows = []
    for i in range(size):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(words)] = f"n{rng.randint(0, 40)}" if rng.random() < 0.3 else f"u{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("edits", "percent", "words"), [([3], 90, 3), ([1, 2, 4, 6], 80, 5)])
def test_large_family_near_the_threshold(spark, edits, percent, words):
    rows = family(random.Random(len(edits)), 160, 100, edits)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), words=words, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, words, percent)


def test_lists_cut_by_differences(spark, monkeypatch):
    """Lists of any length go through pivots."""
    monkeypatch.setattr(ngram_join, "SHORT", 0)
    monkeypatch.setattr(ngram_join, "ROUNDS", 3)
    rng = random.Random(3)
    rows = family(rng, 60, 60, [1, 2, 3, 4]) + [(i + 100, t) for i, t in family(rng, 40, 40, [1, 2, 6])]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), words=3, percent=80).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 80)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_by_position_after_one_pivot(spark, monkeypatch, seed):
    """Branches of one text: near copies within a branch share most of their differences from a pivot in another one."""
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "PAIRS", 0)
    rng = random.Random(seed)
    rows = []
    for _, branch in family(rng, 14, 80, [3, 5]):
        for _ in range(5):
            w = branch.split()
            for _ in range(rng.choice([1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"b{rng.randint(0, 20)}" if rng.random() < 0.3 else f"w{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    want = brute_components(rows, 3, 80)
    assert 2 < len({c for _, _, c in want}) < len(rows)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), words=3, percent=80).collect()
    assert sorted(map(tuple, got)) == want


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(7, "a b c d e f"), (7, "p q r s t u"), (8, "p q r s t u"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), words=3, percent=90).collect()
    assert all(r["component_id"] == 7 for r in got) and len(got) == 6
    left = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA), words=3, percent=90).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [r for r in rows if r[0] in (7, None)]))


def test_members_without_partners_leave_a_large_family(spark, monkeypatch):
    """Most members of a list of shared differences fit nobody of another component, so further rounds of pivots get few of them."""
    rows = family(random.Random(7), 260, 100, [1, 2, 4, 6])
    lists, finer = [], ngram_join._finer
    monkeypatch.setattr(ngram_join, "_finer", lambda *a: lists.append(ngram_join.materialize(finer(*a))) or lists[-1])
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), words=5, percent=80).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 5, 80)
    assert all(x.where("rest is not null").count() <= 4 * len(rows) for x in lists[1:])


def test_which_members_have_partners(spark):
    rows = [("none fits", 1, 100, 1, 10, 3), ("none fits", 2, 100, 2, 40, 30), ("one component", 3, 100, 3, 10, 10), ("one component", 4, 100, 3, 12, 12)]
    rows += [("two fit", 5, 100, 5, 10, 10), ("two fit", 6, 100, 6, 30, 20), ("two fit", 7, 100, 6, 36, 30), ("no places", 8, 100, 8, None, None), ("no places", 9, 100, 8, None, None)]
    lists = spark.createDataFrame([(*r, 0) for r in rows], "key string, v long, n long, component long, differ long, rest long, m long")
    left = ngram_join._with_partners(lists, 80)
    assert sorted((r["key"], r["v"], r["m"]) for r in left.collect()) == [("no places", 8, 2), ("no places", 9, 2), ("two fit", 5, 2), ("two fit", 6, 2)]
