"""Every stage of the corpus pipeline against plain Python, on its own input."""

import hashlib
import random
import re

import pandas as pd
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from clademill.llm import toxicity
from clademill.llm.common import BATCH_ROWS
from tests.llm.test_substring_and_join import brute_components

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage, the output written and read again as run() does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.shared_dir(spark)}/test-{name.replace(' ', '-')}-{random.random()}"
        stage(spark, docs, SF).write.parquet(path)
        left = spark.read.parquet(path)
        out.append((name, docs, left))
        docs = left
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    first = stages["toxicity"][0].columns
    assert all(after.columns == first for name, (_, after) in stages.items() if name != "bpe")


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scored.where("predicted = 0"))


def test_exact_dedup(stages):
    before, after = stages["exact dedup"]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert ids(after) == sorted(first.values())


def test_near_duplicates(stages):
    before, after = stages["near duplicates"]
    found = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == sorted({c for _, _, c in found})


def test_mixing(stages):
    before, after = stages["mixing"]
    known = set(ids(before))
    kept = ids(after)
    assert kept and set(kept) <= known and max(map(kept.count, set(kept))) <= 3


def test_bpe(stages):
    before, after = stages["bpe"]
    tok = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for r in before.collect():
        found = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in after.collect()) == sorted(want)


def test_empty_documents(spark):
    """Without rows, near duplicates, exact dedup, mixing and BPE give none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 0, name


@pytest.mark.parametrize("name", ["toxicity", "near duplicates", "bpe"])
def test_python_stages_get_small_batches(spark, name):
    """After a stage is set up, its Python workers get at most BATCH_ROWS rows at once; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(k, f"some words {k}", "en", "web", 12) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"rows": [len(b)]})

    largest = lambda: max(r["rows"] for r in spark.range(0, 2500, 1, 1).mapInPandas(sizes, "rows long").collect())
    try:
        for limit, expected in ((10_000, BATCH_ROWS), (300, 300)):
            spark.conf.set(key, str(limit))
            dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
            assert largest() == expected
    finally:
        spark.conf.unset(key)
