import hashlib
import random

import numpy as np
import pytest

from clademill.llm import bpe, token_counts

ODD = [
    "", " ", "  a", "a  ", "\n\n x\t", "it's we'll I'D 'S", "naïve café 東京 😀   wide", "x" * 3000, "ab" * 40 + "1" * 70,
    "<|endoftext|> and <|endoftext|>", "a\x00b \x00", "!!!???...", "   nbsp x", "é", "﻿bom", "don't stop 3.14 -- (ok)",
    "a\r\nb", "　　全角", "١٢٣ ４５", "'", " '", "s' 's", " line", "\x85next", "\x1c\x1d a",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.ByteBPE(f.read())


def sample(spark):
    return [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_same_ids_as_the_library(spark, tokenizer, own):
    rng = random.Random(1)
    alphabet = list("abcdeés 0123.,'!\n\t東京😀 ")
    texts = ODD + sample(spark) + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:80]
        assert own.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_short_and_long_ways_agree(own):
    rng = random.Random(2)
    words = [bytes(rng.choices(b"abcdefghij ", k=rng.randint(1, 64))) for _ in range(500)]
    assert own.encode_short(words, 64) == [own.encode_long(w) for w in words]


def test_query_rows(spark, tokenizer):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (7, ODD[7]), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "2 as n_tokens")
    got = sorted(map(repr, bpe.encode_and_check(df).collect()))
    want = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    from pyspark.sql import Row

    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append(Row(doc_id=i, n_tokens=len(ids), ids_sha256=sha(",".join(map(str, ids))), decoded_sha256=sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(map(repr, want))


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {k: t for k, t in enumerate(ODD)} | {99: ""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_and_check(df).collect() == [] and token_counts.token_counts(df).collect() == []


def test_token_counts_against_brute_force(spark, tokenizer):
    texts = sample(spark) + ["", None, "same", "same", "a " * 30_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "1 as length", "2 as n_docs")
    lengths = np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts])
    sums = token_counts.token_counts(df)
    rows = {r["length"]: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths.tolist()))
    for n, r in rows.items():
        assert r["n_docs"] == (lengths == n).sum() and r["docs_total"] == len(lengths) and r["tokens_total"] == lengths.sum()
        assert r["docs_longer"] == (lengths > n).sum() and r["tokens_longer"] == lengths[lengths > n].sum()
        assert r["truncated_total"] == np.minimum(lengths, n).sum()
        assert r["quantile"] == pytest.approx((lengths <= n).mean())
    limits = [0, 1, 7, 100, 512, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        c = r["context"]
        assert (r["docs_longer"], r["tokens_longer"], r["truncated_total"]) == (
            (lengths > c).sum(), lengths[lengths > c].sum(), np.minimum(lengths, c).sum(),
        )
