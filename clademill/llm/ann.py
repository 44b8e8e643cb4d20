"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Vectors from which the centroids are fitted; queries on which the share to visit is measured.
FIT_ROWS, TRIAL_QUERIES = 20_000, 64
#: Distinct vectors aimed at for each cell, the most centroids of a half, entries and queries that are compared at once.
CELL, MOST_CENTROIDS, ENTRIES, QUERIES = 50, 1024, 4096, 1024


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres of k clusters of the rows (Lloyd's rounds); a cluster that empties keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> Iterator[int]:
    """Cells (i, j) that hold entries, as i * len(second) + j, by growing first[i] + second[j]. The heap holds the next pair of
    each row that has been reached."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    a, b, wide = a.tolist(), b.tolist(), len(sb)
    heap = [(fa[0] + sb[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * wide + b[j]
        if counts[cell]:
            yield cell
        if j + 1 < wide:
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(fa):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))


def _vectors(packed: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    recall: float = 0.97,
    seed: int = 0,
) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row whose id is divisible by `every` its k nearest rows found, by
    Euclidean distance in double precision, nearest first, ties to the smaller id; fewer if there are fewer others.

    Vectors are cut into halves; k-means on a bounded sample (FIT_ROWS) gives centroids of each half, and a pair of centroids is
    a cell. Every vector is indexed. A query visits cells by the sum of its squared distances to their two centroids until it has seen a
    share of all entries, and ranks what it saw by exact distance. That share is measured, not guessed: for TRIAL_QUERIES
    queries all true neighbours are found, and the share is the one within which `recall` of them lie.

    Equal vectors are one entry with its k + 1 smallest ids, which are all that can be among k nearest; equal queries are
    searched once. Null, zero and non-finite vectors, those with null components, those whose length isn't the most common one
    (the longer on a tie) and rows with null ids take no part. Of rows that repeat an id and vector one counts. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where("id is not null and v is not null").where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    rows = rows.where(F.size("v") == dim)
    keep = k + 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[bytes, set] = {}
            for i, v in zip(batch["id"].tolist(), batch["v"], strict=True):
                seen.setdefault((np.asarray(v, np.float64) + 0.0).tobytes(), set()).add(i)
            out = [(hashlib.blake2b(v, digest_size=16).hexdigest(), v, sorted(ids)[:keep], any(i % every == 0 for i in ids)) for v, ids in seen.items()]
            yield pd.DataFrame(out, columns=["key", "v", "ids", "asks"])

    packed = rows.mapInPandas(pack, "key string, v binary, ids array<long>, asks boolean")
    salt = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(16))
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    merged = packed.groupBy("key", "v", salt.alias("salt")).agg(least("ids").alias("ids"), F.max("asks").alias("asks"))
    distinct = materialize(merged.groupBy("key", "v").agg(least("ids").alias("ids"), F.max("asks").alias("asks")))
    total = distinct.count()
    wide = int(min(MOST_CENTROIDS, max(2, 2 ** round(np.log2(max(total / CELL, 4)) / 2))))
    half = max(1, dim // 2)
    sample = _vectors(pd.Series([r["v"] for r in distinct.orderBy("key").limit(FIT_ROWS).select("v").collect()]), dim)
    first, second = (centroids(x, min(wide, len(sample)), seed=seed) for x in (sample[:, :half], sample[:, half:]))
    n_second = len(second)
    fitted = spark.sparkContext.broadcast((first, second))

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c1, c2 = fitted.value
        for batch in batches:
            if len(batch):
                x = _vectors(batch["v"], dim)
                yield batch.assign(cell=(nearest(x[:, :half], c1) * n_second + nearest(x[:, half:], c2)).astype(np.int32))

    index = materialize(distinct.mapInPandas(quantise, "key string, v binary, ids array<long>, asks boolean, cell int"))
    counts = np.zeros(len(first) * n_second, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        counts[r["cell"]] = r["count"]

    def distances(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((first - q[:half]) ** 2).sum(1), ((second - q[half:]) ** 2).sum(1)

    asking = index.where("asks")
    trial = asking.orderBy(F.md5("key")).limit(TRIAL_QUERIES).select("key", "v").collect()
    if not trial:
        return spark.createDataFrame([], schema)
    share = _share(index, trial, dim, keep, recall, counts, distances)
    enough = share * total
    # runs of cells with about ENTRIES entries each; a run with more is cut by the entries' keys
    run_of = (np.cumsum(counts) - counts) // ENTRIES
    sizes = np.bincount(run_of, weights=counts).astype(np.int64)
    cuts = np.maximum(1, -(-sizes // (2 * ENTRIES)))
    layout = spark.sparkContext.broadcast((counts, run_of, cuts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, run, cut = layout.value
        for batch in batches:
            r = run[batch["cell"]]
            part = np.array([int(x[:8], 16) for x in batch["key"]], np.int64) % cut[r] if len(batch) else r
            yield batch[["v", "ids", "cell"]].assign(run=r, part=part)

    def bundle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids = group["ids"].map(len)
        return pd.DataFrame(
            {"run": [key[0]], "vs": [b"".join(group["v"])], "cells": [group["cell"].to_numpy()], "ids": [np.concatenate(group["ids"].tolist())], "n_ids": [ids.to_numpy(np.int32)]}
        )

    entries = index.mapInPandas(place, "v binary, ids array<long>, cell int, run long, part long")
    entries = entries.groupBy("run", "part").applyInPandas(bundle, "run long, vs binary, cells array<int>, ids array<long>, n_ids array<int>")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, run, _ = layout.value
        for batch in batches:
            out = []
            for key, v in zip(batch["key"], batch["v"], strict=True):
                found: dict[int, list[int]] = {}
                seen = 0
                for cell in traverse(*distances(np.frombuffer(v, np.float64)), n):
                    found.setdefault(int(run[cell]), []).append(cell)
                    seen += n[cell]
                    if seen >= enough:
                        break
                out += [(key, v, r, cells) for r, cells in found.items()]
            yield pd.DataFrame(out, columns=["key", "v", "run", "cells"])

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"q_run": [key[0]], "keys": [group["key"].tolist()], "qs": [b"".join(group["v"])], "q_cells": [group["cells"].tolist()]}
        )

    n_blocks = max(1, asking.count() // QUERIES)
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks))
    questions = asking.select("key", "v").mapInPandas(visit, "key string, v binary, run long, cells array<int>")
    questions = questions.groupBy("run", block.alias("block")).applyInPandas(
        gather, "q_run long, keys array<string>, qs binary, q_cells array<array<int>>"
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, q = (np.frombuffer(b, np.float64).reshape(-1, dim) for b in (row.vs, row.qs))
                cells, n_ids, ids = np.asarray(row.cells), np.asarray(row.n_ids), np.asarray(row.ids)
                start = np.cumsum(n_ids) - n_ids
                out = []
                for key, v, own in zip(row.keys, q, row.q_cells, strict=True):
                    at = np.flatnonzero(np.isin(cells, own))
                    d = np.sqrt(((x[at] - v) ** 2).sum(1))
                    if len(at) > keep:
                        edge = np.partition(d, keep - 1)[keep - 1]
                        at, d = at[d <= edge], d[d <= edge]
                    many = n_ids[at]
                    flat = np.concatenate([ids[s : s + m] for s, m in zip(start[at], many, strict=True)]) if len(at) else ids[:0]
                    dist = np.repeat(d, many)
                    best = np.lexsort((flat, dist))[:keep]
                    out.append((key, flat[best], dist[best]))
                yield pd.DataFrame(out, columns=["key", "near", "dist"])

    partial = entries.join(questions, F.col("run") == F.col("q_run")).mapInPandas(compare, "key string, near array<long>, dist array<double>")

    def best(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        near, dist = np.concatenate(group["near"].tolist()), np.concatenate(group["dist"].tolist())
        at = np.lexsort((near, dist))[:keep]
        return pd.DataFrame({"key": [key[0]], "near": [near[at]], "dist": [dist[at]]})

    found = materialize(partial.groupBy("key").applyInPandas(best, "key string, near array<long>, dist array<double>"))

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, hashlib.blake2b((np.asarray(v, np.float64) + 0.0).tobytes(), digest_size=16).hexdigest()) for i, v in zip(batch["id"], batch["v"], strict=True)]
            yield pd.DataFrame(out, columns=["query_id", "q_key"])

    asked = rows.where(F.col("id") % every == 0).mapInPandas(identify, "query_id long, q_key string")
    answers = asked.join(found, F.col("q_key") == F.col("key")).distinct()
    both = F.filter(F.arrays_zip(F.col("near").alias("near"), F.col("dist").alias("dist")), lambda x: x["near"] != F.col("query_id"))
    return answers.select("query_id", F.posexplode(F.slice(both, 1, k)).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.near").alias(id_col), F.col("x.dist").alias("score")
    )


def _share(index: DataFrame, trial: list, dim: int, keep: int, recall: float, counts: np.ndarray, distances) -> float:
    """The share of all entries that a traversal must see to meet `recall` of the trial queries' true neighbours.
    Every partition compares the few trial queries with its entries and keeps each one's nearest."""
    q = np.stack([np.frombuffer(r["v"], np.float64) for r in trial])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, cells = _vectors(batch["v"], dim), batch["cell"].to_numpy()
            out = []
            for k, v in enumerate(q):
                d = np.sqrt(((x - v) ** 2).sum(1))
                at = np.argsort(d, kind="stable")[:keep]
                out.append((k, d[at], cells[at]))
            yield pd.DataFrame(out, columns=["q", "dist", "cells"])

    def least(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        dist, cells = np.concatenate(group["dist"].tolist()), np.concatenate(group["cells"].tolist())
        return pd.DataFrame({"q": [key[0]], "cells": [cells[np.argsort(dist, kind="stable")[:keep]]]})

    scanned = index.select("v", "cell").mapInPandas(scan, "q int, dist array<double>, cells array<int>")
    seen_at = []
    for r in scanned.groupBy("q").applyInPandas(least, "q int, cells array<int>").collect():
        after, seen = {}, 0
        for cell in traverse(*distances(q[r["q"]]), counts):
            seen += counts[cell]
            after[cell] = seen
        seen_at += [after[c] for c in r["cells"][1:]]  # the first is the query itself
    if not seen_at:
        return 1.0
    return min(1.0, float(np.quantile(seen_at, recall, method="higher")) / counts.sum())
