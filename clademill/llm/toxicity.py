"""Toxicity: a support vector machine on a gappy subsequence kernel, with Nystroem landmarks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Documents of each label to learn from; sentences of each label; landmarks; rounds in which hard clean units are added.
FIT_DOCS, FIT_SENTENCES, LANDMARKS, HARD_ROUNDS = 6000, 6000, 96, 2
#: Landmarks that may share their first letters.
ALIKE = 6
#: Letters of a subsequence, decay for each skipped letter, span up to which subsequences count.
LETTERS, DECAY, SPAN = 3, 0.6, 6
#: Longest unit that is compared at once, and the step of the windows that cover longer ones.
WIDTH, STEP = 12, 4
SYMBOLS = 64
#: Characters of the texts that are judged at once. With the tokens that a Scorer remembers this is most of what a Python worker takes.
BLOCK_CHARS = 500_000
PREDICTED_FROM = 0.7
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (b + 1 - LETTERS) for _, b in _OFFSETS], np.float32)
#: By length: the root of the sum of squared weights of all a unit's subsequences, by which kernel values are divided.
_NORMS = np.array([max(1e-9, sum(DECAY ** (2 * (b + 1 - LETTERS)) * max(0, n - b) for _, b in _OFFSETS)) ** 0.5 for n in range(WIDTH + 1)], np.float32)
_SENTENCE = re.compile(r"[.!?\n]+")
#: Letters that stand alone, as in a word that is spelled out with gaps.
_SPELLED = re.compile(r"(?<!\S)(?:\S{1,2}[ \t]+){2,}\S{1,2}(?!\S)")


def clean(token: str) -> str:
    """Letters and digits of a token, in lower case: separators inside a word fall out."""
    return token.lower() if token.isalnum() else "".join(filter(str.isalnum, token.lower()))


def cover(word: str) -> list[str]:
    """The word between marks of its ends, or windows that cover it whole if it is long."""
    unit = f"^{word}$"
    if len(unit) <= WIDTH:
        return [unit]
    starts = [*range(0, len(unit) - WIDTH, STEP), len(unit) - WIDTH]
    return [unit[s : s + WIDTH] for s in starts]


def spelled_runs(text: str) -> list[tuple[list[str], list[tuple[int, int, str]]]]:
    """Runs of single letters: the tokens of each, and the words that it may spell: (start, tokens, unit) of every stretch of 3 to WIDTH tokens,
    joined."""
    out = []
    for m in _SPELLED.finditer(text):
        run = [clean(t) for t in m[0].split()]
        some = [(i, n, "^" + "".join(run[i : i + n]) + "$") for i in range(len(run)) for n in range(3, min(WIDTH, len(run) - i) + 1)]
        out.append((run, [s for s in some if LETTERS + 1 < len(s[2]) <= WIDTH]))
    return out


def spelled(text: str) -> list[str]:
    """Words that runs of single letters may spell."""
    return [u for _, some in spelled_runs(text) for _, _, u in some]


def _apart(run: list[str], some: list[tuple[int, int, str]], value: list[float]) -> tuple[list[tuple[float, str]], int]:
    """The stretches of a run that decide for toxic and don't overlap, by falling value, and how many words the run is: each of them is one,
    and so are single letters between them."""
    owner = [-1] * len(run)
    hits: list[tuple[float, str]] = []
    for v, n, i, u in sorted(((v, n, i, u) for (i, n, u), v in zip(some, value, strict=True) if v > 0), key=lambda s: (-s[0], -s[1], s[2])):
        if max(owner[i : i + n]) < 0:
            owner[i : i + n] = [len(hits)] * n
            hits.append((v, u))
    words = len(hits)
    for hit, rest in itertools.groupby(range(len(run)), key=owner.__getitem__):
        if hit < 0:
            left = [run[k] for k in rest]
            words += 1 if max(map(len, left)) <= 1 else len(left)
    return hits, words


def units(text: str) -> list[str]:
    """All units of a text: words without separators, long ones in windows, and spelled-out words."""
    words = {clean(t) for t in text.split()}
    return sorted({u for w in words if len(w) >= LETTERS for u in cover(w)} | {*spelled(text)})


def encode(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (n, WIDTH) and lengths of units: a letter or digit has a symbol of its own, the marks too, others share 26."""
    n = np.fromiter(map(len, some), np.int64, len(some))
    points = np.frombuffer("".join(u.ljust(WIDTH, "\0") for u in some).encode("utf-32-le"), np.uint32).reshape(-1, WIDTH).astype(np.int64)
    out = 38 + points % 26
    out = np.where(points == 94, 36, np.where(points == 36, 37, out))  # the marks
    out = np.where((points >= 97) & (points <= 122), points - 97, out)
    return np.where((points >= 48) & (points <= 57), points - 48 + 26, out), n


def subsequences(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pair of gaps: the codes of the three-letter subsequences from every start, and their weights (0 beyond the end)."""
    for (a, b), w in zip(_OFFSETS, _WEIGHTS, strict=True):
        starts = WIDTH - b
        code = (codes[:, :starts] * SYMBOLS + codes[:, a : a + starts]) * SYMBOLS + codes[:, b : b + starts]
        yield code, np.where(np.arange(starts) + b < lengths[:, None], w, np.float32(0))


def compact_map(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the subsequences that a few units (landmarks) have, and the units' feature vectors in these columns."""
    codes, lengths = encode(some)
    found = list(subsequences(codes, lengths))
    columns = np.unique(np.concatenate([code[weight > 0] for code, weight in found]))
    out = np.zeros((len(some), len(columns)), np.float32)
    for code, weight in found:
        for j in range(code.shape[1]):
            has = np.flatnonzero(weight[:, j] > 0)
            np.add.at(out, (has, np.searchsorted(columns, code[has, j])), weight[has, j])
    return columns, out / _NORMS[np.minimum(lengths, WIDTH), None]


def feature_map(some: list[str]) -> np.ndarray:
    """Dense feature vectors of a few units: kernel values are their dot products with others' subsequences."""
    columns, values = compact_map(some)
    out = np.zeros((len(some), SYMBOLS**LETTERS), np.float32)
    out[:, columns] = values
    return out


def kernel(some: list[str], table: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of the units with each column of table (symbols ** letters, columns): a sum over their subsequences.
    With row, table has only some of the codes' rows, and row tells where each code's is."""
    out = np.zeros((len(some), table.shape[1]), np.float32)
    for k in range(0, len(some), 4096):
        codes, lengths = encode(some[k : k + 4096])
        for code, weight in subsequences(codes, lengths):
            for j in range(code.shape[1]):
                out[k : k + 4096] += weight[:, j, None] * table[code[:, j] if row is None else row[code[:, j]]]
        out[k : k + 4096] /= _NORMS[lengths][:, None]
    return out


class Scorer:
    """Judges texts by the decision values of their units. Remembers tokens."""

    def __init__(self, table: np.ndarray, bias: float, curve: tuple[np.ndarray, float, float] | None = None, keep: int = 100_000):
        self.table, self.bias, self.curve, self.keep = table, bias, curve, keep
        self.known: dict[str, float] = {}

    def decide(self, some: list[str]) -> np.ndarray:
        return kernel(some, self.table[:, None])[:, 0] + self.bias

    def _learn(self, new: list[str]) -> None:
        pieces, owner = [], []
        for i, t in enumerate(new):
            word = clean(t)
            if len(word) >= LETTERS:
                some = cover(word)
                pieces += some
                owner += [i] * len(some)
        value = np.full(len(new), self.bias)
        if pieces:
            np.maximum.at(value, owner, self.decide(pieces))
        self.known.update(zip(new, value.tolist(), strict=True))

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each whole text: words that decide for toxic, distinct ones, all words (spelled-out ones count once each), the sum of all words' weights from 0 to 1
        by decision value, and the two highest decision values."""
        out = np.zeros((len(texts), 6))
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < BLOCK_CHARS:
                chars += len(texts[end])
                end += 1
            block = [t.split() for t in texts[start:end]]
            new = list(set().union(*block).difference(self.known))
            if len(self.known) + len(new) > self.keep:
                self.known.clear()
                new = list(set().union(*block))
            self._learn(new)
            look_up = self.known.__getitem__
            for k, tokens in enumerate(block):
                value = np.fromiter(map(look_up, tokens), float, len(tokens))
                kinds = {t for t, hit in zip(tokens, value > 0, strict=True) if hit} if len(value) and value.max() > 0 else ()
                names, words = {*map(clean, kinds)}, len(tokens)
                if runs := spelled_runs(texts[start + k]):
                    some = [u for _, stretches in runs for _, _, u in stretches]
                    decided = iter(self.decide(some).tolist() if some else ())
                    for run, stretches in runs:
                        found, n = _apart(run, stretches, list(itertools.islice(decided, len(stretches))))
                        value = np.append(value, [v for v, _ in found])
                        names |= {u[1:-1] for _, u in found}
                        words += n - len(run)
                hits, types = (value > 0).sum(), len(names)
                top = np.sort(value)[::-1][:2].clip(-1, 1)
                out[start + k] = (hits, types, words, (np.clip(value, -0.5, 0.5) + 0.5).sum(), *top, *[-1.0] * (2 - len(top)))
            start = end
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        weights, *rates = self.curve
        return 1 / (1 + np.exp(-np.clip(evidence(features, *rates) @ weights[:-1] + weights[-1], -40, 40)))


def evidence(features: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Columns for the logistic curve. toxic and clean: such words for each word of documents of either label; the first column
    is the log likelihood ratio of as many of them among so many words."""
    hits, types, words, soft, first, second = features.T
    few = np.minimum(types, 6)
    counted = np.minimum(hits, 3 * types)  # a line that is repeated counts little
    ratio = np.clip(counted * np.log(toxic / clean) - words * (toxic - clean), -12, 12)
    return np.stack(
        [
            ratio, np.log1p(hits), np.log1p(types), few, few >= 2, np.log((types + 0.2) / (words + 20)), np.log((soft + 0.2) / (words + 20)),
            np.minimum(words, 1000) / 100, np.log(words + 20), first, second,
        ],
        1,
    )


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights (the bias last) of a linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    total = weight.sum()
    reg = np.full(x.shape[1], penalty)
    reg[-1] = 1e-6
    bound = 2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x / total)[-1] + 2 * penalty
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = -2 * ((weight * slack * y) @ x) / total + 2 * reg * v
        new = v - gradient / bound
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def _variants(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit's word with letters inserted or doubled, as disguised words have."""
    out, word = [], unit.strip("^$")
    for _ in range(4):
        at = int(rng.integers(1, len(word)))
        letter = "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))]
        out += [cover(word[:at] + letter + word[at:])[0], cover(word[:at] + word[at - 1] + word[at:])[0]]
    return out


def _calibrated(features: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights (the constant last) of the logistic curve through labelled documents' features (Newton's steps), and rates for
    evidence()."""
    rates = [(features[toxic == y, 0].sum() + r) / (features[toxic == y, 2].sum() + 1000) for y, r in ((1, 2), (0, 0.5))]
    rates = (max(rates[0], 1.5 * rates[1]), rates[1])
    x = evidence(features, *rates)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], 3e-4 * len(x))
    penalty[-1] = 1e-6 * len(x)
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        b = b + np.linalg.solve(h, z.T @ (toxic - p) - penalty * b)
    return np.append(b[:-1] / scale, b[-1] - (b[:-1] / scale * mean).sum()), *rates


def _constant(probability: float) -> Scorer:
    weights = np.zeros(12)
    weights[-1] = np.log(probability / (1 - probability))
    return Scorer(np.zeros(SYMBOLS**LETTERS, np.float32), -1.0, (weights, 0.02, 0.01))


def fit(train: DataFrame, seed: int = 0) -> Scorer:
    """train: (id, text, y), a bounded sample of labelled documents.

    Every sentence of a clean document is clean; of a toxic document, some are toxic, unknown which. Units that are far more frequent in toxic
    documents are its first witnesses: sentences with one are toxic examples, represented by it. The machine then picks
    each toxic sentence's highest unit itself, and clean units that it rates highest join the clean examples.
    """
    spark = train.sparkSession
    rng = np.random.default_rng(seed)
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return _constant(0.05 if n.get(0) else 0.5)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                own = units(text)
                # near copies share a mark, so that their words don't count many times
                mark = min((hash_of(u) for u in own if len(u) >= 9), default=hash_of(text))
                rows.append((y, mark, own))
            yield pd.DataFrame(rows, columns=["y", "mark", "units"])

    def hash_of(s: str) -> int:
        import zlib

        return zlib.crc32(s.encode())

    docs = materialize(train.mapInPandas(split, "y int, mark long, units array<string>"))
    seen = docs.select("y", "mark", F.explode("units").alias("unit")).groupBy("unit").agg(
        F.count_distinct(F.when(F.col("y") == 1, F.col("mark"))).alias("t"), F.count_distinct(F.when(F.col("y") == 0, F.col("mark"))).alias("c")
    )
    seen = materialize(seen)
    rate_t, rate_c = F.col("t") / n[1], F.col("c") / n[0]
    # log likelihood ratio against one rate for both labels; by chance, few of the units compared come above the log of their number
    both, p = F.col("t") + F.col("c"), n[1] / (n[1] + n[0])
    z = F.col("t") * F.log(F.col("t") / (both * p)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - p)))).otherwise(0.0)
    least = float(np.log(max(2, seen.where("t >= 3").count()))) + 1
    ranked = seen.where("t >= 3").where(rate_t >= 8 * rate_c).select("unit", z.alias("z")).where(F.col("z") >= least)
    witness = {r["unit"]: r["z"] for r in ranked.orderBy(F.desc("z"), "unit").limit(1500).collect()}
    ordinary = [r["unit"] for r in seen.where("t + c >= 1 and c > 0").orderBy(F.md5("unit")).limit(30_000).select("unit").collect()]
    common = [r["unit"] for r in seen.where("c > 0").orderBy(F.desc("c"), "unit").limit(5_000).select("unit").collect()]
    if not witness:
        return _constant(min(0.5, n[1] / (n[1] + n[0])))
    # landmarks differ: few of them begin alike
    begins: dict[str, int] = {}
    strong = [u for u in witness if (begins.update({u[:5]: begins.get(u[:5], 0) + 1}) or begins[u[:5]]) <= ALIKE][: LANDMARKS * 2 // 3]
    marks = strong + common[: LANDMARKS - len(strong)]
    columns, base = compact_map(marks)
    row = np.zeros(SYMBOLS**LETTERS, np.int32)
    row[columns] = np.arange(1, len(columns) + 1)
    of_marks = np.vstack([np.zeros((1, len(marks)), np.float32), base.T])
    gram = (base @ base.T).astype(float)
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-4 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    shared = spark.sparkContext.broadcast(set(witness))

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                for sentence in _SENTENCE.split(text):
                    own = units(sentence)
                    if y == 1 and not shared.value.isdisjoint(own):
                        rows.append((hash_of(sentence), own))
            yield pd.DataFrame(rows, columns=["order", "units"])

    toxic = train.where("y = 1").mapInPandas(sentences, "order long, units array<string>").dropDuplicates(["units"])
    toxic = [list(r["units"]) for r in toxic.orderBy("order", "units").limit(FIT_SENTENCES).collect()]
    picked = [max(s, key=lambda u: witness.get(u, 0)) for s in toxic]
    negative = [u for u in dict.fromkeys(common + ordinary) if u not in witness]
    table, bias = np.zeros(SYMBOLS**LETTERS, np.float32), 0.0
    for turn in range(HARD_ROUNDS + 1):
        weight_of = pd.Series(picked).value_counts()
        positive = list(weight_of.index)
        disguised = [v for u in positive if len(u) >= 4 for v in _variants(u, rng)]
        every = positive + disguised + negative
        x = kernel(every, of_marks, row) @ whiten
        y = np.array([1.0] * (len(positive) + len(disguised)) + [-1.0] * len(negative))
        share = np.concatenate(
            [np.sqrt(weight_of.to_numpy(float)), np.full(len(disguised), 0.1), np.ones(len(negative))]
        )
        share[y > 0] *= share[y < 0].sum() / share[y > 0].sum() / 2
        w = machine(x, y, share)
        table = np.zeros(SYMBOLS**LETTERS, np.float32)
        table[columns] = base.T @ (whiten @ w[:-1])
        bias = float(w[-1])
        if turn == HARD_ROUNDS:
            break
        scorer = Scorer(table, bias)
        flat = [u for s in toxic for u in s]
        score = dict(zip(flat, scorer.decide(flat).tolist(), strict=True))
        picked = [max(s, key=lambda u: (u in witness, score[u])) for s in toxic]
        current = spark.sparkContext.broadcast((table, bias))

        def rate(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            s = Scorer(*current.value)
            for batch in batches:
                yield batch.assign(value=s.decide(batch["unit"].tolist())) if len(batch) else batch.assign(value=0.0)

        hard = seen.where("c >= 2 or t = 0").where("c > 0").select("unit").mapInPandas(rate, "unit string, value float")
        hard = [r["unit"] for r in hard.where("value > -0.9").orderBy(F.desc("value"), "unit").limit(3000).collect()]
        negative = list(dict.fromkeys(negative + [u for u in hard if u not in witness]))
    model = spark.sparkContext.broadcast((table, bias))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(*model.value)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": list(s.features(batch["text"].tolist()))})

    judged = train.select("text", "y").mapInPandas(judge, "y int, x array<double>").toPandas()
    return Scorer(table, bias, _calibrated(np.stack(judged["x"]), judged["y"].to_numpy(float)))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.7).

    A text is judged by its suspicious units, their number, share and decision values: a unit is a word without separators, a window
    of a long word, or a word spelled out in single letters. Units are compared with landmarks by shared subsequences of three letters, each skipped letter costing a
    factor, so that gaps and inserted letters lower the similarity without ending it. As the kernel's features are few,
    the machine's sum over landmarks is one table over subsequences.

    Learns from at most fit_docs labelled documents of each label that aren't held out, the first by a hash of their id; all documents
    are scored, whole. The fit's other bounds, all on what these documents give: FIT_SENTENCES toxic sentences (first by a hash), 1,500 witnesses
    (highest ratio), 30,000 ordinary and 5,000 common clean units, and 3,000 hard ones in each of HARD_ROUNDS rounds. Letters beyond a-z and
    digits share 26 symbols. Where no unit is clearly more frequent in toxic documents (in three or more, by the likelihood ratio), there is nothing to
    learn from and all scores are equal. Only the text feeds a score. Null labels and those of no document are ignored; a document with two labels counts with both. Null and
    empty texts get the lowest score; repeated rows equal ones. Without labels of both kinds, all scores are equal. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(~held_out("label_id") & F.col("y").isin(0, 1) & F.col("label_id").isNotNull())
    order = F.md5(F.col("label_id").cast("string").cast("binary"))
    chosen = [known.where(F.col("y") == y).orderBy(order, "label_id").limit(fit_docs) for y in (0, 1)]
    # at most 2 * fit_docs ids, whatever the input
    train = materialize(rows.join(F.broadcast(chosen[0].union(chosen[1])), F.col("id") == F.col("label_id")).select("id", "text", "y"))
    s = fit(train)
    model = docs.sparkSession.sparkContext.broadcast((s.table, s.bias, s.curve))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": scorer.probability(scorer.features(batch["text"].tolist()))})

    scored = rows.mapInPandas(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    bad = materialize(toxicity(docs, labels, id_col, text_col).where("predicted = 1").select(F.col(id_col).alias("bad_id")).distinct())
    return docs.join(bad, docs[f"`{id_col}`"] == bad["bad_id"], "left_anti")
