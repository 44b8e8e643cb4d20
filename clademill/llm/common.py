"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, at most, where small_batches() is called: texts or pairs of sets of some MB.
BATCH_ROWS = 1000
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps start from the files, so a lost
    executor costs no recomputation, and the rows are free of any earlier partitioning by key."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to BATCH_ROWS rows; a smaller limit stays. A task holds a batch several times: in the
    executor's memory beside its heap, as Arrow and as pandas in its Python worker, and workers keep what they once took."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id: Column | str) -> Column:
    """True for rows kept from training: crc32 of the id as text, modulo 3, is 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class WordHashes(dict):
    """Maps words (bytes) to 64-bit hashes and keeps those already seen; at most `keep` of them."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
