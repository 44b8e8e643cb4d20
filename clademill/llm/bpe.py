"""Byte-level BPE over whole documents: encoding by contiguous rank arrays, decoding, digests."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which byte-level BPE vocabularies cut text; white space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
#: Pieces up to so many bytes are encoded in blocks by rank arrays; longer ones with a heap.
SHORT = 64
#: Characters of the documents that are encoded together, and chunks that a worker remembers.
BLOCK_CHARS, KEEP = 500_000, 200_000
NONE = np.int32(2**31 - 1)


def default_path() -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: Latin-1's own where it is
    printable, else the next free one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Known(dict):
    """Chunks and their ids; notes those that aren't known."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, None] = {}

    def __missing__(self, chunk: str) -> None:
        self.new[chunk] = None


class ByteBPE:
    """Encodes and decodes as a byte-level tokenizer file (JSON) says, its added tokens included."""

    def __init__(self, config: str):
        model = json.loads(config)
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        vocab = model["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max(max(vocab.values()), *self.added.values(), 0) + 1
        self.size = size
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.added:
                self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c in byte_chars()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = np.append(keys[order], np.int64(-1) + 2**62), np.append(order.astype(np.int32), NONE)
        self.rank_dict = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.first = self._look_up(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.cut = regex.compile(PATTERN).findall
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known = Known()
        self.text_of = [str(i) for i in range(size)]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where it doesn't merge (or an id is -1)."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], NONE)

    def encode_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (as int32 bytes) of words of at most width bytes. A row per word holds its parts (what the remaining
        boundaries enclose) and the ranks of adjacent parts, side by side. Each pass scans every row for its lowest
        rank, leftmost first, deletes that boundary by shifting the rest left, and ranks the two new neighbours."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < lengths[:, None]
        parts = np.full((n, width + 1), -1, np.int32)
        parts[:, :width] = np.where(inside, self.byte_id[raw], -1)
        ranks = np.full((n, width + 1), NONE, np.int32)
        ranks[:, : width - 1] = np.where(inside[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], NONE)
        found: list = [None] * n
        live = np.arange(n)
        at = np.arange(width + 1)
        while len(live):
            best = ranks.argmin(1)
            rows = np.arange(len(live))
            low = ranks[rows, best]
            over = low == NONE
            if over.any():
                done = parts[over]
                full = done >= 0
                ends = (4 * full.sum(1).cumsum()).tolist()
                flat = done[full].tobytes()
                start = 0
                for k, end in zip(live[over].tolist(), ends, strict=True):
                    found[k] = flat[start:end]
                    start = end
                go = ~over
                live, parts, ranks, best, low = live[go], parts[go], ranks[go], best[go], low[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            shift = np.minimum(at + (at > best[:, None]), width)
            parts = np.take_along_axis(parts, shift, 1)
            here = self.merged[low]
            parts[rows, best] = here
            ranks = np.take_along_axis(ranks, shift, 1)
            ranks[rows, best] = self._look_up(here, parts[rows, best + 1])
            inner = np.flatnonzero(best)
            before = best[inner] - 1
            ranks[inner, before] = self._look_up(parts[inner, before], here[inner])
        return found

    def encode_long(self, word: bytes) -> bytes:
        """Ids of a word of any length: the same merges in the same order, from a heap of (rank, position)."""
        parts = [int(self.byte_id[b]) for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.rank_dict.get(parts[i] * self.size + parts[j])
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(x, y)) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the pattern cuts, those of similar length together."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list = [b""] * len(raw)
        low = 0
        for width in (8, 12, 16, 24, SHORT):
            at = np.flatnonzero((lengths > low) & (lengths <= width)).tolist()
            for k in range(0, len(at), 20_000):
                some = at[k : k + 20_000]
                for i, ids in zip(some, self.encode_short([raw[i] for i in some], width), strict=True):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = self.encode_long(raw[i])
        return out

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks. A chunk is what stands between spaces, the space before it included. The pattern
        always cuts there, unless the chunk is empty or ends or starts with white space: False marks those. Most
        chunks are a word with ASCII punctuation behind it, which are two pieces."""
        words, ends, plain, other, parts = [], [], [], [], []
        for c in chunks:
            w = c.rstrip(PUNCTUATION)
            if w.isalpha() or (w[:1] == " " and w[1:].isalpha()):
                plain.append(c)
                words.append(w)
                ends.append(c[len(w) :])
            else:
                other.append(c)
        if len(self.known) + len(chunks) > KEEP:
            self.known.clear()
        rest = dict.fromkeys(ends, b"")
        rest = dict(zip(rest, self.encode_pieces(list(rest)), strict=True))
        self.known.update(zip(plain, map(bytes.__add__, self.encode_pieces(words), map(rest.__getitem__, ends)), strict=True))
        cuts = [None if not c.strip(" ") or c[-1].isspace() or c[c[0] == " "].isspace() else self.cut(c) for c in other]
        parts = list(dict.fromkeys(chain.from_iterable(c for c in cuts if c)))
        ids = dict(zip(parts, self.encode_pieces(parts), strict=True))
        self.known.update((c, False if ps is None else b"".join([ids[p] for p in ps])) for c, ps in zip(other, cuts, strict=True))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, cut by the pattern as a whole."""
        pieces = self.cut(text)
        parts = list(dict.fromkeys(pieces))
        ids = dict(zip(parts, self.encode_pieces(parts), strict=True))
        return b"".join([ids[p] for p in pieces])

    def _with_added(self, text: str) -> bytes:
        parts, at = [], 0
        for m in self.split_added.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*parts, self._plain(text[at:])])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < BLOCK_CHARS:
                chars += len(texts[end])
                end += 1
            block = texts[start:end]
            # between spaces; each chunk but a text's first is looked up with its space
            chunks = [t.replace(" ", "\0 ").split("\0") if t and "\0" not in t else () for t in block]
            found = [list(map(self.known.__getitem__, c)) for c in chunks]
            new, self.known.new = self.known.new, {}
            if new:
                self.learn(list(new))
                known = self.known
                found = [[known[w] if f is None else f for f, w in zip(fs, c, strict=True)] for fs, c in zip(found, chunks, strict=True)]
            for t, c, ids in zip(block, chunks, found, strict=True):
                if not t:
                    out = b""
                elif self.split_added and self.split_added.search(t):
                    out = self._with_added(t)
                else:
                    out = self._plain(t) if not c or False in ids else b"".join(ids)
                yield np.frombuffer(out, np.int32)
            start = end

    def counts(self, texts: list[str]) -> Iterator[int]:
        """The number of ids of each text."""
        return map(len, self.encode(texts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(config: str) -> ByteBPE:
    """The tokenizer of a configuration; a worker process builds it once and keeps its pieces between tasks."""
    key = hashlib.sha256(config.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(config)
    return _loaded[key]


def _config(docs: DataFrame, path: str | None):
    """The vocabulary file, read by the driver and broadcast: a file of fixed size, the same for any input."""
    with open(path or default_path(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids array<int>: the token ids of each whole text. Null and empty texts have none."""
    config = _config(docs, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(config.value)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": pd.Series(list(bpe.encode(b["text"].tolist())), dtype=object)})

    return _input(docs, id_col, text_col).mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id, text: the text that the ids stand for; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""
    config = _config(tokens, path)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(config.value)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [bpe.decode([] if i is None else i) for i in b["ids"]]}, dtype=object)

    rows = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text
    that the ids decode to). Encoding and decoding happen in one pass, so that no ids are moved.

    Documents are encoded whole, each for itself; rows that repeat are encoded alike. Null and empty texts have no
    tokens and the digests of nothing. A text of one endless word takes time n log n. Other columns are ignored.
    """
    config = _config(docs, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(config.value)
        text_of = bpe.text_of.__getitem__
        for b in batches:
            rows = []
            for found in bpe.encode(b["text"].tolist()):
                ids = found.tolist()
                joined = ",".join(map(text_of, ids)).encode()
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _input(docs, id_col, text_col).mapInPandas(run, schema).withColumnRenamed("id", id_col)
