"""Grouped prefix join: documents whose sets of word shingles are similar, and the components they form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, materialize, mix64
from .components import components

NO_ID = 2**63 - 1
#: Buckets of a set's signature. Lists of up to SHORT members are compared pair by pair, longer ones through pivots first, ROUNDS times.
BUCKETS, SHORT, ROUNDS = 64, 16, 2
#: Pairs for each class up to which the longer lists are finished pair by pair.
PAIRS = 8
#: The largest bitmap of ids has 2 ** MAP_BITS bits (32 MB).
MAP_BITS = 28
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of k consecutive words each; of all words at once, if they are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = mix64(out * _STEP + hashes[j : n - width + 1 + j])
    return np.unique(out)


class Sets:
    """Shingle sets of texts."""

    def __init__(self, k: int):
        self.k, self.words = k, WordHashes()

    def of(self, text: str) -> np.ndarray:
        return shingles(self.words.of(text.encode().translate(ASCII_LOWER).split()), self.k)


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


# Bounds, for numbers and columns alike. A set of n items shares at least _least(n) with any similar one and lacks fewer than _slack(n) of its items.


def _least(n, percent: int):
    return -((-percent * n) // 100) if isinstance(n, int) else ((F.lit(percent) * n + 99) / 100).cast("long")


def _slack(n, percent: int):
    return n - _least(n, percent) + 1


def _shared(n, percent: int):
    """How many items the heads of two similar sets share, at least, if the smaller has n items."""
    a, b = _slack(n, percent), _least(n, percent)
    return min(a, b) if isinstance(n, int) else F.least(a, b)


def _reach(n: Column, percent: int) -> Column:
    """No similar set differs from one of n items by more items than this."""
    return n * ((100 - percent) / percent)


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach, its own included).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a set holds a document's distinct shingles of
    `words` words, as 64-bit hashes. Two documents link when 100 x intersection >= percent x union. The way there:

    1. Heads. Two similar sets share a certain number of their least hashes. Documents whose head holds too few hashes
    that any other document's head has drop out; that is one aggregation of heads, whatever the number of documents.
    2. Of the rest, documents with one set become one class, and whole sets are counted: shingles of one class alone are
    set aside, the others ordered from rare to common. Similar sets share a shingle of their prefixes in that order.
    3. Classes with the same prefix and size form a group. Groups meet in the lists of their prefixes' shingles, each with
    the group in it that has the commonest shingles, the pivot; group pairs whose sizes fit are expanded to members and verified.
    4. Lists whose members are in several components still are cut finer: members that differ from their pivot in few
    items can only be similar if they share some of these differences, so they meet in a list for each (pivot, difference);
    the others stay in their list, for another pivot. Of lists with the same members one is compared, and of two members' common
    differences only those early enough that enough others may follow bring them together; members that none of another component fits go. Lists of up to SHORT members are compared pair by pair, where sizes and
    bucket counts allow a similarity, and so are all lists once these pairs are no more than PAIRS for each class,
    or after ROUNDS rounds.

    So links inside a component may go unseen, but no two components that a link joins stay apart.

    Null and empty texts have no shingles and are their own component. Null ids count as larger than any and come back
    null. Rows that share an id but not a text are documents of their own. Repeated rows get equal results. Other columns are ignored.
    An empty table gives an empty result.
    """
    doc = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    every = materialize(_heads(doc, words, percent).withColumn("k", F.monotonically_increasing_id()))
    alive = materialize(_with_common_heads(every, percent))
    sets = materialize(_sets(doc, alive, words).withColumn("v", F.monotonically_increasing_id()))
    labels = _linked(sets, percent)
    return _answer(every.select("id", "n", "cls"), sets.select("v", "cls"), labels, id_col)


def _heads(doc: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, cls, head): size and digest of each document's set, and its least hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                s = sets.of(text)
                n = len(s)
                rows.append((i, n, _digest(s), s[: _slack(n, percent) + _shared(n, percent) - 1].view(np.int64) if n else s.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "n", "cls", "head"])

    return doc.mapInPandas(run, "id long, n long, cls binary, head array<long>")


def _with_common_heads(every: DataFrame, percent: int) -> DataFrame:
    """(cls, id): the classes, one row each, whose heads hold enough hashes of other documents' heads."""
    tokens = every.select("k", F.explode("head").alias("token"))
    alone = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("k")).where("c = 1").groupBy("k").agg(F.count(F.lit(1)).alias("alone"))
    left = every.where("n > 0").select("k", "cls", "id", "n", F.size("head").alias("held")).join(alone, "k", "left")
    needed = _shared(_least(F.col("n"), percent), percent)
    return left.where(F.col("held") - F.coalesce("alone", F.lit(0)) >= needed).groupBy("cls").agg(F.min("id").alias("id"))


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """Bits set for the hashes of the wanted ids: eight for each id, at most 2 ** MAP_BITS. Beyond that more ids pass that nobody wants."""
    bits = min(max(wanted.count() * 8, 1 << 19).bit_length(), MAP_BITS)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, group in batch.groupby("part"):
                at = np.unique(group["bit"].to_numpy())
                yield pd.DataFrame({"part": [part], "bits": [at.astype(np.uint16).tobytes()]})

    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    hashed = wanted.select((at / (1 << 16)).cast("int").alias("part"), (at % (1 << 16)).cast("int").alias("bit"))
    bitmap = np.zeros(1 << bits, bool)
    for r in hashed.mapInPandas(pack, "part int, bits binary").toLocalIterator():
        bitmap[r["part"] * 65536 + np.frombuffer(r["bits"], np.uint16).astype(np.int64)] = True
    return np.packbits(bitmap)


def _sets(doc: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, n, items, sig) of the wanted classes, one row each; sig counts items by their last bits. A bitmap of
    bounded size keeps most other documents' sets from being dealt out for the join that takes exactly the wanted ones."""
    bitmap = _bitmap(wanted)
    bits = len(bitmap) * 8
    shared = doc.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for batch in batches:
            at = batch["at"].to_numpy()
            hit = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            rows = []
            for text in batch["text"][hit]:
                s = sets.of(text)
                if len(s):
                    sig = np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
                    rows.append((_digest(s), len(s), s.view(np.int64), sig.tobytes()))
            yield pd.DataFrame(rows, columns=["cls", "n", "items", "sig"])

    built = doc.select("text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at")).mapInPandas(build, "cls binary, n long, items array<long>, sig binary")
    # each task keeps one row of a class before rows are dealt out by class, once; an inner join, as a semi join would be moved below that
    return built.dropDuplicates(["cls"]).join(wanted.select(F.col("cls").alias("c")), F.col("cls") == F.col("c")).drop("c")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, mass, prefix): shingles of several classes from rare to common, as many as two similar sets need to meet; mass tells how
    common a set's shingles are on average."""
    every = sets.select("v", F.explode("items").alias("token"))
    alone = every.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v")).where("c = 1").groupBy("v").agg(F.count(F.lit(1)).alias("alone"))
    enough = sets.select("v", "n").join(alone, "v", "left").where(F.col("n") - F.coalesce("alone", F.lit(0)) >= _least(F.col("n"), percent)).select("v")
    tokens = sets.select("v", "n", "items").join(materialize(enough), "v", "left_semi").select("v", "n", F.explode("items").alias("token"))
    common = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    counted = tokens.join(common, "token").groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("q"), F.sum(F.log2("c")).alias("mass"))
    least = _least(F.col("n"), percent)
    kept = counted.where(F.size("q") >= least)
    return kept.select("v", "n", F.round(F.col("mass") / F.col("n"), 6).alias("mass"), F.slice(F.col("q.token"), F.lit(1), (F.size("q") - least + 1).cast("int")).alias("prefix"))


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes v that have links."""
    pre = materialize(_prefixes(sets, percent))
    named = pre.withColumn("grp", F.md5(F.concat_ws(",", F.col("n").cast("string"), F.transform("prefix", lambda t: t.cast("string"))).cast("binary")))
    top = F.max(F.struct("mass", "v")).alias("top")
    groups = named.groupBy("grp").agg(F.min("v").alias("g"), top, F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = materialize(groups.select("grp", "g", "top", "n", "prefix"))
    member = materialize(named.select("grp", "v", "n", "mass").join(groups.select("grp", "g"), "grp").select("g", "v", "n", "mass"))
    posted = groups.select("g", "n", "top", F.explode("prefix").alias("key"))
    pivots = materialize(posted.groupBy("key").agg(F.max("top").alias("p"), F.max(F.struct("top", "n"))["n"].alias("pn"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    lists = materialize(posted.select("key", "g", "n").join(pivots.select("key", "p", "pn"), "key").select("key", "g", "n", "p", "pn"))
    # group pairs: every group with the pivot of its lists that has the commonest shingles, and with its own pivot; then their members
    with_pivot = lists.where((F.col("g") != F.col("p.v")) & _sizes_fit("n", "pn", percent)).groupBy("g").agg(F.max("p").alias("p"))
    met = with_pivot.select("g", F.col("p.v").alias("p")).union(groups.select("g", F.col("top.v").alias("p")))
    pairs = met.join(member.select("g", "v"), "g").where("p <> v").select(F.least("p", "v").alias("a"), F.greatest("p", "v").alias("b")).distinct()
    links = [_compared(pairs, sets, percent)]
    labels = _hints(links[0])
    # lists as (key, v) from here on: those in whose groups there are several components, and groups of several members
    mine = materialize(_labelled(member, labels))
    parts = mine.groupBy("g").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = lists.select("key", "g").join(parts, "g").groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("key")
    own = mine.join(parts.where("least < most").select("g"), "g", "left_semi").select(F.col("g").alias("key"), "v")
    state = lists.select("key", "g").join(materialize(mixed), "key", "left_semi").join(mine.select("g", "v"), "g").select(F.xxhash64("key").alias("key"), "v").union(own)
    state = materialize(_without_place(state.distinct()))
    facts = pre.select("v", "n", "mass")
    rest, few, turn = [], PAIRS * pre.count(), 0
    while True:
        full = _mixed_lists(state, facts, labels)
        full = _with_partners(full, percent) if turn else full
        long = materialize(full.where(F.col("m") > SHORT))
        left = long.agg(F.sum((F.col("m") - 1) / 2)).first()[0] or 0
        last = left <= few or turn == ROUNDS
        rest.append(materialize(_all_pairs(full if last else full.where(F.col("m") <= SHORT), percent)))
        if last:
            break
        turn += 1
        pivot = long.groupBy("key").agg(F.max(F.struct("mass", "v", "n")).alias("p")).select("key", F.col("p.v").alias("p"), F.col("p.n").alias("pn"))
        placed = materialize(long.join(materialize(pivot), "key").where("p <> v").select("key", "v", "n", "p", "pn"))
        apart = materialize(_differences(placed.select("p", "pn", "v", "n").distinct(), sets, percent))
        links.append(apart.where("similar").select(F.col("p").alias("a"), F.col("v").alias("b")))
        labels = _hints(reduce(DataFrame.union, links))
        state = materialize(_finer(placed, apart, labels, percent))
    links.append(_compared(reduce(DataFrame.union, rest).distinct(), sets, percent))
    return components(reduce(DataFrame.union, links))


def _hints(links: DataFrame) -> DataFrame:
    """(id, component) as far as two steps along the links tell: equal components are connected, others may be, too."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
    second = both.join(first.select(F.col("a").alias("b"), "least"), "b").groupBy("a").agg(F.min("least").alias("component"))
    return materialize(second.select(F.col("a").alias("id"), "component"))


def _labelled(member: DataFrame, labels: DataFrame) -> DataFrame:
    mine = labels.select(F.col("id").alias("l_id"), F.col("component").alias("l"))
    return member.join(mine, F.col("v") == F.col("l_id"), "left").withColumn("component", F.coalesce("l", "v")).drop("l_id", "l")


def _mixed_lists(state: DataFrame, facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, v, n, mass, component, m, differ, rest) of the lists whose m members are in several components. Of a pivot's lists with the
    same members the one of the rarest item stays: a changed word changes several shingles, each with a list of its own."""
    known = _labelled(state.join(facts, "v"), labels)
    same = [F.bit_xor(F.xxhash64("v", F.lit(k))).alias(f"same{k}") for k in range(2)]
    sizes = known.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("component").alias("least"), F.max("component").alias("most"), F.max("p").alias("p"), F.sum("rest").alias("rest"), *same
    )
    mixed = sizes.where("least < most").groupBy("m", "p", "same0", "same1").agg(F.max(F.struct("rest", "key"))["key"].alias("key"))
    return materialize(known.drop("p").join(materialize(mixed.select("key", "m")), "key"))


def _with_partners(lists: DataFrame, percent: int) -> DataFrame:
    """The lists without the members whose positions fit no member of another component, by the list's extremes alone. As _all_pairs says, a
    pair (x, y) needs 2 rest(x) - |d(x)| + reach(x) >= |d(y)|, and the same with x and y exchanged. Lists without positions stay as they are."""
    lists = lists.withColumn("most", 2 * F.col("rest") - F.col("differ") + _reach(F.col("n"), percent) + 1e-6)
    each = materialize(lists.groupBy("key", "component").agg(F.min("differ").alias("d"), F.max("most").alias("g")))
    ends = each.groupBy("key").agg(F.min(F.struct("d", "component")).alias("low"), F.max(F.struct("g", "component")).alias("high"))
    other = lambda c, end: F.when(F.col("component") != F.col(f"{end}.component"), F.col(c))
    second = each.join(materialize(ends), "key").groupBy("key", "low", "high").agg(F.min(other("d", "low")).alias("d2"), F.max(other("g", "high")).alias("g2"))
    near = F.when(F.col("component") == F.col("low.component"), F.col("d2")).otherwise(F.col("low.d"))
    far = F.when(F.col("component") == F.col("high.component"), F.col("g2")).otherwise(F.col("high.g"))
    fits = F.col("rest").isNull() | ((F.col("most") >= near) & (F.col("differ") <= far))
    left = materialize(lists.join(materialize(second), "key").where(fits).select(*[c for c in lists.columns if c not in ("m", "most")]))
    return materialize(left.join(materialize(left.groupBy("key").agg(F.count(F.lit(1)).alias("m"))), "key"))


def _all_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's members of different components whose sizes and positions fit: in the list of the first item that two sets of
    differences share, they can share no more items than either has from there on (rest). Lists without positions (null) have no such test."""
    x = lists.select("key", F.col("v").alias("a"), F.col("n").alias("an"), F.col("component").alias("ac"), F.col("differ").alias("ad"), F.col("rest").alias("ar"))
    y = lists.select("key", F.col("v").alias("b"), F.col("n").alias("bn"), F.col("component").alias("bc"), F.col("differ").alias("bd"), F.col("rest").alias("br"))
    apart = (F.col("an") + F.col("bn")) * ((100 - percent) / (100 + percent))
    place = F.coalesce(2 * F.least("ar", "br") + apart + 1e-6 >= F.col("ad") + F.col("bd"), F.lit(True))
    return x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & _sizes_fit("an", "bn", percent) & place).select("a", "b").distinct()


def _met(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b, ...) with a column of both from the table."""
    x = table.select(F.col("v").alias("xv"), F.col(column).alias("x"))
    y = table.select(F.col("v").alias("yv"), F.col(column).alias("y"))
    return pairs.join(x, F.col("a") == F.col("xv")).drop("xv").join(y, F.col("b") == F.col("yv")).drop("yv")


def _bucket_bound(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures: the most items that the sets can share, and the sum of their sizes."""
    x, y = (np.frombuffer(b"".join(batch[c]), np.uint32).reshape(-1, BUCKETS).astype(np.int64) for c in ("x", "y"))
    return np.minimum(x, y).sum(1), x.sum(1) + y.sum(1)


def _sets_in(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    return sets.select("v", "items").join(materialize(wanted), "v", "left_semi")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar ones of the pairs (a, b): by bucket counts first, then by whole sets."""

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                both, total = _bucket_bound(batch)
                yield batch.loc[100 * both >= percent * (total - both), ["a", "b"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[ok, ["a", "b"]]

    hopeful = materialize(_met(pairs, sets, "sig").mapInPandas(possible, "a long, b long"))
    return materialize(_met(hopeful, _sets_in(hopeful, sets), "items").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long"))


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(p, pn, v, n, similar, differ, delta): the items that only one of p and v has, if v is near p: within 3 / t reaches of v.
    Pairs that are farther apart have no row."""
    radius = 3 * (100 - percent) / percent * 100 / percent

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                both, total = _bucket_bound(batch)
                yield batch.loc[total - 2 * both <= radius * batch["n"].to_numpy() + 1e-6, ["a", "pn", "b", "n"]]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, pn, v, n, x, y in batch[["a", "pn", "b", "n", "x", "y"]].itertuples(index=False):
                delta = np.setxor1d(x, y, assume_unique=True)
                both = (pn + n - len(delta)) // 2
                if len(delta) <= radius * n + 1e-6:
                    rows.append((p, pn, v, n, 100 * both >= percent * (pn + n - both), len(delta), delta))
            yield pd.DataFrame(rows, columns=["p", "pn", "v", "n", "similar", "differ", "delta"])

    named = pairs.select(F.col("p").alias("a"), "pn", F.col("v").alias("b"), "n")
    hopeful = materialize(_met(named, sets, "sig").mapInPandas(possible, "a long, pn long, b long, n long"))
    met = _met(hopeful, _sets_in(hopeful, sets), "items")
    return met.mapInPandas(measure, "p long, pn long, v long, n long, similar boolean, differ long, delta array<long>")


def _finer(placed: DataFrame, apart: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The next lists (key, v, p, differ, rest). Take two similar sets x and y that no link to their list's pivot p joins, and call d the items
    in which a set differs from p: |d(x)| + |d(y)| - 2 |both| is what x and y differ in, at most a reach. So they share items of
    d, at least (|d(x)| - reach(x)) of them; and at least half of |d(x)|, less what p and x differ in size, if x is similar to p and y is not.
    Those within 3 / t reaches of p meet by their rarest shared differences, those beyond 2 reaches stay together: two similar sets
    are both of the one kind or both of the other. As x and y need comparing in different components only, so do the differences: those that
    all their holders near p have in one component are left out. differ is |d(x)|; rest counts the shared differences of x from the list's own on."""
    reach, kappa = _reach(F.col("n"), percent), (100 - percent) / (100 + percent)
    needed = F.when(F.col("similar"), (F.col("differ") - kappa * F.abs(F.col("pn") - F.col("n"))) / 2).otherwise(F.col("differ") - reach)
    needed = F.greatest(F.lit(1), F.ceil(needed - 1e-6))
    known = _labelled(apart.select("p", "v", "differ", needed.alias("needed"), "delta"), labels)
    token = materialize(known.select("p", "v", "component", "differ", "needed", F.explode("delta").alias("token")))
    common = token.groupBy("p", "token").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("least"), F.max("component").alias("most"))
    common = materialize(common.where("least < most").select("p", "token", "c"))
    held = token.join(common, ["p", "token"]).groupBy("p", "v", "differ", "needed").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("q"))
    first = F.slice(F.col("q.token"), F.lit(1), (F.size("q") - F.col("needed") + 1).cast("int"))
    fine = held.where(F.size("q") >= F.col("needed")).select("p", "v", "differ", F.size("q").alias("held"), F.posexplode(first).alias("at", "token"))
    near = apart.where(F.col("differ") <= 2 * reach).select("p", "v")
    far = placed.join(near, ["p", "v"], "left_anti").select(F.xxhash64("key", F.lit("far")).alias("key"), "v")
    placed_at = fine.select(F.xxhash64("p", "token").alias("key"), "v", "p", "differ", (F.col("held") - F.col("at")).cast("long").alias("rest"))
    return placed_at.union(_without_place(far)).distinct()


def _without_place(lists: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return lists.select("key", "v", none.alias("p"), none.alias("differ"), none.alias("rest"))


def _answer(every: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """A row for each document: the least id of its component's classes, or else of its class."""
    least = materialize(every.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    known = classes.join(labels, F.col("v") == F.col("id")).select("cls", "component").join(least.select("cls", "rep"), "cls")
    lowest = materialize(known.groupBy("component").agg(F.min("rep").alias("lowest")))
    better = known.join(lowest, "component").select("cls", "lowest")
    rep = least.join(better, "cls", "left").where("rows > 1 or lowest is not null").select(F.col("cls").alias("c"), F.coalesce("lowest", "rep").alias("rep"))
    out = every.join(materialize(rep), F.col("cls") == F.col("c"), "left")
    shown = lambda c: F.when(c != NO_ID, c)
    return out.select(shown(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), shown(F.coalesce("rep", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their own columns, of each component those with the least id.

    Empty and null texts stay. Rows without an id stay, as none of them can be told from another. Rows that repeat an id
    share a fate: they go if one of them has a lesser id in its component.
    """
    found = ngram_components(docs, id_col, text_col, words, percent)
    lost = materialize(found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("lost_id")).distinct())
    return docs.join(lost, docs[f"`{id_col}`"] == lost["lost_id"], "left_anti")


ORACLE_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
  from d
), n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 90 * (na.n + nb.n - common)
), e as (select a, b from l union select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from n union select e.b, r.c from r join e on e.a = r.doc_id where r.c < e.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce((select min(c) from r where r.doc_id = d.doc_id), d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id
"""
