"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Random features, ridge penalty per training row, buckets of raw scores for the calibration.
FEATURES, RIDGE, BUCKETS = 256, 1e-4, 2000
N_STATS = 22


def _share(bytes_: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(bytes_)] = 1
    return out


_GROUPS = np.stack(
    [
        _share(bytes(range(65, 91))), _share(bytes(range(97, 123))), _share(b"0123456789"), _share(bytes(range(128, 256))),
        _share(b" "), _share(b"\n"), _share(b"!"), _share(b"|"), _share(b"#$%&*"), _share(b".,;:"), _share(b"?'\"()[]{}<>/\\@_-+=~^`"),
    ]
)


def statistics(text: str) -> np.ndarray:
    """Numbers that describe a whole text; zeros for an empty one."""
    b = text.encode()
    out = np.zeros(N_STATS)
    if not b:
        return out
    n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words, lines = b.split(), b.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    p = n[n > 0] / len(b)
    count = max(1, len(words))
    out[:11] = _GROUPS @ n / len(b)
    out[11:] = (
        np.log1p(len(b)),
        np.log1p(len(words)),
        lengths.mean() if len(words) else 0,
        lengths.std() if len(words) else 0,
        np.log1p(lengths.max() if len(words) else 0),
        (lengths <= 3).sum() / count,
        len(set(words)) / count,
        len(set(lines)) / len(lines),
        np.log1p(len(b) / len(lines)),
        -(p * np.log2(p)).sum(),
        len(zlib.compress(b, 1)) / len(b),
    )
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text; null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "x": [statistics(t) for t in batch["text"]]})

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, x array<double>")


class Model:
    """Standardises, maps to random Fourier features of a Gaussian kernel, scores linearly and calibrates."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, np.where(scale > 0, scale, 1)
        self.turn = rng.normal(size=(d, FEATURES)) / np.sqrt(d)  # kernel width: the square root of the dimension
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + d + 1)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.shift)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to y by weighted squares: neighbours that fall are pooled."""
    level, size, count = [], [], []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        level.append(v)
        size.append(w)
        count.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            b, wb, nb = level.pop(), size.pop(), count.pop()
            level[-1] = (level[-1] * size[-1] + b * wb) / (size[-1] + wb)
            size[-1] += wb
            count[-1] += nb
    return np.repeat(level, count)


def fit(train: DataFrame) -> Model:
    """train: (x array<double>, y double). Every row counts; partitions send sums of fixed size only.

    Without rows the score is 0.5; with one class only, it is that class."""
    moments = train.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    mean, scale = np.zeros(len(moments)), np.ones(len(moments))
    for r in moments:
        mean[r["k"]], scale[r["k"]] = r["m"], r["s"]
    model = Model(mean, scale)
    width = len(model.weights) + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = np.hstack([model.features(np.stack(batch["x"])), batch[["y"]].to_numpy()])
                total += z.T @ z
        yield pd.DataFrame({"k": np.arange(width), "row": [r.tobytes() for r in total]})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "row": [sum(np.frombuffer(r) for r in group["row"]).tobytes()]})

    total = np.zeros((width, width))
    for r in train.mapInPandas(sums, "k int, row binary").groupBy("k").applyInPandas(add, "k int, row binary").collect():
        total[r["k"]] = np.frombuffer(r["row"])
    a, b, n = total[:-1, :-1], total[:-1, -1], total[0, 0]
    penalty = np.full(width - 1, RIDGE * n)
    penalty[0] = 0
    model.weights = np.linalg.solve(a + np.diag(penalty + 1e-9), b)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(np.stack(batch["x"])), -0.5, 1.5)
                yield pd.DataFrame({"bucket": np.round(raw * BUCKETS / 2).astype(np.int64), "y": batch["y"]})

    binned = train.mapInPandas(place, "bucket long, y double").groupBy("bucket").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
    found = sorted((r["bucket"], r["n"], r["s"]) for r in binned.collect())  # at most 2 * BUCKETS rows
    at, n, s = (np.array(c, float) for c in zip(*found, strict=True))
    model.steps = (at * 2 / BUCKETS, isotonic(s / n, n))
    return model


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Learns from labelled documents that aren't held out, all of them: sums of products of their features, added over
    partitions, give the ridge solution, and counts by bucket of score its isotonic calibration. Only the text feeds a score. Labels
    that are null or belong to no document are ignored; a document with two labels counts with both. Null ids are never labelled. Rows that repeat
    are scored alike. Without usable labels every score is 0.5. Other columns are ignored.
    """
    stats = materialize(document_statistics(docs, id_col, text_col))
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).where(~held_out("label_id") & F.col("y").isNotNull())
    train = materialize(stats.join(known, F.col("id") == F.col("label_id")).select("x", "y"))
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "score": model.value.score(np.stack(batch["x"]))})

    scored = stats.mapInPandas(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
