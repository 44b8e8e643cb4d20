import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.llm import ann, chat

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(v).astype(float))), None)
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


def test_recall_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got, want = found(ann.search(table)), brute(rows, 100, 10)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    assert recall(got, want) >= 0.9
    for q in got:
        scores = dict(want[q])
        assert all(scores[i] == pytest.approx(d, rel=1e-12) for i, d in got[q] if i in scores)


def test_clusters_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 5
    rows = [(k, (centres[k % 20] + rng.normal(size=16)).tolist()) for k in range(3000)]
    rows += [(k, rows[7][1]) for k in range(3000, 4300)]  # a large group of copies, some of them queries
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [float("inf")] + [1.0] * 15), (5500, [1.0] * 3), (None, rows[1][1]), (8, rows[8][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "key", "ids", "cell", "query_id"):
        df = df.withColumn(name, F.lit("own"))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 16], 100, 10)
    got = found(ann.search(df))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert got[3100] == [(i, 0.0) for i in [7, *range(3000, 3009)]]


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 3.0]), (7, [4.0, 2.0])]
    assert found(ann.search(spark.createDataFrame(rows, SCHEMA))) == {0: [(100, 1.0), (7, 3.0)], 100: [(0, 1.0), (7, 10**0.5)]}
    assert found(ann.search(spark.createDataFrame(rows[:1], SCHEMA))) == {}
    assert ann.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.search(spark.createDataFrame([(1, [0.0])], SCHEMA)).collect() == []


def test_traverse_goes_by_growing_sums():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(9)
    counts = rng.integers(0, 3, 63)
    cells = list(ann.traverse(a, b, counts))
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(counts).tolist()


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations", [("user", "hi"), ("assistant", "yo")]),
    ({"prompt": "p", "completion": "c", "score": 3}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction-input-output", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": None, "output": "o"}, "instruction-input-output", [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": 4}, "question-answer", [("user", "q"), ("assistant", "4")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system-prompt-response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"turns": [{"turn": 2, "role": "assistant", "text": "b"}, {"turn": 1, "role": "user", "text": "a"}]}, "turns", [("user", "a"), ("assistant", "b")]),
    ({"other": 1}, None, None),
    ([1, 2], None, None),
]


def test_layouts_become_canonical_turns(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(LAYOUTS)] + [(50, None), (51, "not json"), (None, json.dumps(LAYOUTS[0][0]))]
    df = spark.createDataFrame(rows, "conv_id long, record string").selectExpr("*", "1 as id", "2 as turns", "3 as formatted")
    got = {r["conv_id"]: r for r in chat.chat_format(df).collect()}
    assert len(got) == len(rows)
    for k, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[k]["layout"] == layout
        assert (turns is None and got[k]["turns"] is None) or [(t["role"], t["text"]) for t in got[k]["turns"]] == turns
    assert got[50]["turns"] is None and got[51]["formatted"] is None and got[None]["layout"] == "messages"


def test_template_is_reversible():
    rng = random.Random(1)
    bits = ["<turn ", "</turn>", "</turn>\n", "\\", ">", "user", "\n", "x", "<", "/turn>", "é😀", ""]
    for _ in range(3000):
        turns = [("".join(rng.choices(["assistant", "user", *bits], k=rng.randint(0, 3))), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        formatted, spans = chat.format_turns(turns)
        assert chat.read_turns(formatted) == turns
        assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_digests_of_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (2, 1, None, "x"), (2, None, "user", "first"), (3, 1, "assistant", "w " * 50_000), (3, 1, "assistant", "w " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat.planted(spark))
    got = {r["conv_id"]: r for r in chat.digests(chat.chat_format(chat.records_of(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha("user\n\nassistant\nb\n"), 1, sha("b"))
    assert (got[2]["turns_sha256"], got[2]["loss_chars"]) == (sha("user\nfirst\n\nx\n"), 0)
    assert (got[3]["n_turns"], got[3]["loss_chars"]) == (2, 200_000)
    text = "\\### Assistant: </turn> ok"
    assert (got[-7]["n_turns"], got[-7]["loss_sha256"]) == (2, sha(text))
    assert chat.digests(chat.chat_format(chat.records_of(df.where("conv_id = 77")))).collect() == []
