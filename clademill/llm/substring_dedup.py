"""Removal of word windows that an earlier document also holds, behind a count-min prefilter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, mix64

#: Words of an anchor; rows of the sketch; cells of a row that one merged block holds.
ANCHOR, ROWS, BLOCK = 16, 2, 1 << 16
#: Cells for each anchor that the input may hold, and the least and largest power of two of a row's cells.
CELLS_PER_ANCHOR, LEAST, LARGEST = 8, 20, 30
NO_ID = 2**63 - 1
_Q = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MULTIPLIERS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Windows:
    """Hashes of word windows: prefix sums of word hashes times powers of an odd number, modulo 2**64."""

    def __init__(self):
        self.words = WordHashes()
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers.get(which, (np.empty(0), np.empty(0)))
        if len(up) < n:
            size = max(4096, 2 * n)
            inverse = np.uint64(pow(int(_Q[which]), -1, 2**64))
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, q)]), dtype=np.uint64) for q in (_Q[which], inverse))
            self.powers[which] = (up, down)
        return up, down

    def sums(self, hashes: np.ndarray, which: int) -> np.ndarray:
        up, _ = self._powers(which, len(hashes) + 1)
        h = mix64(hashes) if which else hashes
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, which: int, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of so many words from each start (from all, if none are given)."""
        _, down = self._powers(which, len(sums))
        if starts is None:
            n = len(sums) - length
            return mix64((sums[length:] - sums[:n]) * down[:n])
        return mix64((sums[starts + length] - sums[starts]) * down[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(w: Windows, hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For every window its anchor: the least hash of the runs of `anchor` words in it. Equal windows have equal anchors."""
    return sliding_min(w.of(w.sums(hashes, 0), 0, anchor), window - anchor + 1)


def _cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((values * _MULTIPLIERS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, window: int, anchor: int, bits: int) -> list[tuple[int, int, bytes]]:
    """The merged sketch: for each row and block a bitmap of the cells that two documents or more may have hit.

    Each partition counts its documents' anchors (each once a document) up to two in sketch cells and sends the cells
    that aren't zero, packed by block; merging adds them up. What comes back has 2**bits / 8 bytes a row.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows()
        pending: list[np.ndarray] = []
        held = 0

        def send() -> pd.DataFrame:
            values = np.concatenate(pending)
            rows = []
            for row in range(ROWS):
                cells, n = np.unique(_cells(values, row, bits), return_counts=True)
                block = cells // BLOCK
                packed = ((cells % BLOCK) * 2 + (n > 1)).astype(np.uint32)
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                for b, part in zip(block[edges].tolist(), np.split(packed, edges[1:]), strict=True):
                    rows.append((row, b, part.tobytes()))
            return pd.DataFrame(rows, columns=["row", "block", "cells"])

        for batch in batches:
            for text in batch["text"]:
                words = text.encode().split()
                if len(words) >= window:
                    own = np.unique(anchors(w, w.words.of(words), window, anchor))
                    pending.append(own)
                    held += len(own)
                    if held >= 2_000_000:
                        yield send()
                        pending, held = [], 0
        if pending:
            yield send()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(BLOCK, np.int32)
        for packed in group["cells"]:
            c = np.frombuffer(packed, np.uint32).astype(np.int64)
            n[c >> 1] += 1 + (c & 1)
        return pd.DataFrame({"row": [key[0]], "block": [key[1]], "often": [np.packbits(n > 1).tobytes()]})

    counted = docs.mapInPandas(count, "row int, block int, cells binary")
    merged = counted.groupBy("row", "block").applyInPandas(merge, "row int, block int, often binary")
    return [(r["row"], r["block"], bytes(r["often"])) for r in merged.collect()]


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    anchor: int = ANCHOR,
    largest_bits: int = LARGEST,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and kept_text if with_text).

    A word goes when a window of `window` consecutive words covers it whose words also start a window in a document
    of smaller id; windows are judged on the input. First, count-min sketches of the windows' anchors, one for each
    partition and then merged, overestimate how many documents hold a window; the sketch grows with the input up to
    2**largest_bits cells a row and its bitmaps are broadcast (at most 2 x 2**largest_bits / 8 bytes). Second, the windows
    estimated to be in two documents or more are grouped by 128 bits of hash of their words, whole and over all
    documents; a smaller sketch lets more windows pass and loses none. Copies of whole documents are settled by their
    digest before, so that a large group of copies costs a row each.

    Null and empty texts have no words. Documents shorter than a window lose nothing. Null ids count as larger than
    any. Rows of one id don't remove each other's words; rows that repeat id and words get the same result. Other
    columns are ignored.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor lies within a window")
    doc = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    chars = doc.agg(F.sum(F.length("text"))).first()[0] or 0
    expected = max(1, chars // 6 * 2 // (window - anchor + 2))
    bits = min(max(LEAST, (CELLS_PER_ANCHOR * expected).bit_length()), max(LEAST, largest_bits))
    often = np.zeros((ROWS, 2**bits // 8), np.uint8)
    for row, block, packed in sketch(doc.select("text"), window, anchor, bits):
        often[row, block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(packed, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def flagged(w: Windows, hashes: np.ndarray) -> np.ndarray:
        """Starts of the windows that pass the sketch."""
        values = anchors(w, hashes, window, anchor)
        passes = np.ones(len(values), bool)
        for row in range(ROWS):
            c = _cells(values, row, bits)
            passes &= (shared.value[row, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return np.flatnonzero(passes)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows()
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                words = text.encode().split()
                body = b" ".join(words)
                some = len(words) >= window and len(flagged(w, w.words.of(words))) > 0
                sha = hashlib.sha256(body)
                # id and tag tell apart rows whose id repeats
                tag = int.from_bytes(sha.digest()[:8], "little", signed=True)
                rows.append((i, tag, len(words), sha.hexdigest(), body.decode() if some else None))
            yield pd.DataFrame(rows, columns=["id", "tag", "n_words", "sha", "body"])

    judged = materialize(doc.mapInPandas(judge, "id long, tag long, n_words long, sha string, body string"))

    firsts = materialize(
        judged.where(f"n_words >= {window}").groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    ).select(F.col("sha").alias("s"), "first")
    ids = judged.select("id", "tag", "sha")
    lost = materialize(ids.join(firsts, F.col("sha") == F.col("s")).where("id > first").select("id", "tag").distinct())
    lost = lost.select(F.col("id").alias("lost_id"), F.col("tag").alias("lost_tag"))
    is_lost = (F.col("id") == F.col("lost_id")) & (F.col("tag") == F.col("lost_tag"))
    open_docs = materialize(judged.where("body is not null").select("id", "tag", "body").join(lost, is_lost, "left_anti"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows()
        for batch in batches:
            parts, held = [], 0
            for k, (i, tag, body) in enumerate(zip(batch["id"], batch["tag"], batch["body"], strict=True)):
                hashes = w.words.of(body.encode().split())
                starts = flagged(w, hashes)
                n = len(starts)
                hashed = [w.of(w.sums(hashes, which), which, window, starts).view(np.int64) for which in (0, 1)]
                parts.append((*hashed, np.full(n, i), np.full(n, tag), starts.astype(np.int32)))
                held += n
                if held >= 200_000 or k == len(batch) - 1:
                    yield pd.DataFrame(dict(zip(("a", "b", "id", "tag", "start"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                    parts, held = [], 0

    every = open_docs.mapInPandas(windows, "a long, b long, id long, tag long, start int")
    repeated = materialize(
        every.select("a", "b", "id").groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    ).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "first")
    covered = (
        every.join(repeated, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")))
        .where("id > first")
        .groupBy("id", "tag")
        .agg(F.collect_list("start").alias("starts"))
        .select(F.col("id").alias("c_id"), F.col("tag").alias("c_tag"), "starts")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, tag, body, starts in zip(batch["id"], batch["tag"], batch["body"], batch["starts"], strict=True):
                words = body.encode().split()
                at = np.asarray(starts, np.int64)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])
                rows.append((i, tag, int((~stay).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pd.DataFrame(rows, columns=["cut_id", "cut_tag", "removed", "kept", "text"])

    shortened = (
        open_docs.join(covered, (F.col("id") == F.col("c_id")) & (F.col("tag") == F.col("c_tag")))
        .select("id", "tag", "body", "starts")
        .mapInPandas(cut, "cut_id long, cut_tag long, removed long, kept string, text string")
        .dropDuplicates(["cut_id", "cut_tag"])
    )
    # text of documents that lose nothing comes from the input, which alone has it
    base = judged.select("id", "tag", "n_words", "sha")
    if with_text:
        whole = doc.select(F.col("id"), F.regexp_replace(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), "^$", "").alias("whole"))
        base = whole.withColumn("sha", F.sha2("whole", 256)).join(judged.select("id", "tag", "n_words", "sha").distinct(), ["id", "sha"])
    out = (
        base.join(lost, is_lost, "left")
        .join(shortened, (F.col("id") == F.col("cut_id")) & (F.col("tag") == F.col("cut_tag")), "left")
    )
    gone = F.col("lost_id").isNotNull()
    columns = [
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        F.col("n_words"),
        F.when(gone, F.col("n_words")).otherwise(F.coalesce(F.col("removed"), F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce(F.col("kept"), F.col("sha"))).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(gone, F.lit("")).otherwise(F.coalesce(F.col("text"), F.col("whole"))).alias("kept_text"))
    return out.select(*columns)


ORACLE_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), p as (
  select doc_id, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50
), x as (
  select p.doc_id, p.i, md5(array_to_string(d.w[p.i : p.i + 49], ' ')) as h from p join d on d.doc_id = p.doc_id
), f as (select h, min(doc_id) as first from x group by 1),
c as (select x.doc_id, x.i from x join f on f.h = x.h where f.first < x.doc_id),
cw as (select distinct doc_id, unnest(range(i, i + 50)) as k from c),
g as (select doc_id, list(k) as ks, count(*) as n from cw group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed,
  sha256(array_to_string(case when g.n is null then d.w else list_filter(d.w, lambda v, k: not list_contains(g.ks, k)) end, ' ')) as kept_sha256
from d left join g on g.doc_id = d.doc_id
"""
