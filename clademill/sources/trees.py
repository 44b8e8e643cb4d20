"""Newick trees: rows (tree_id, newick) become nodes and splits, and nodes become Newick again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TreeError(ValueError):
    """A tree that can't be read."""


@dataclass
class Node:
    name: str = ""
    length: float | None = None
    children: list[Node] = field(default_factory=list)


_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+")


def parse(newick: str) -> Node:
    """The root of a tree; comments in brackets are skipped, quoted labels may hold anything."""
    root = here = Node()
    path: list[Node] = []
    want_length = closed = False
    for m in _TOKEN.finditer(newick):
        t = m[0]
        if t[0] == "[":
            continue
        if closed:
            raise TreeError("text after the end")
        if want_length and t in "(),:;":
            raise TreeError("a length is missing")
        if t == "(":
            path.append(here)
            here.children.append(Node())
            here = here.children[-1]
        elif t == ",":
            if not path:
                raise TreeError("comma outside of parentheses")
            path[-1].children.append(Node())
            here = path[-1].children[-1]
        elif t == ")":
            if not path:
                raise TreeError("one parenthesis too many")
            here = path.pop()
        elif t == ":":
            want_length = True
        elif t == ";":
            closed = True
        elif want_length:
            try:
                here.length, want_length = float(t), False
            except ValueError:
                raise TreeError(f"no length: {t}") from None
        elif here.name or here.length is not None:
            raise TreeError(f"one label too many: {t}")
        else:
            here.name = t[1:-1].replace("''", "'") if t[0] == "'" else t
    if path or not closed:
        raise TreeError("the tree doesn't end")
    return root


def unrooted(root: Node) -> Node:
    """The tree with a root of three children or more: a root of two gives way to its first inner child."""
    if len(root.children) != 2:
        return root
    a, b = root.children
    if not a.children:
        a, b = b, a
    if not a.children:
        return root
    if a.length is not None or b.length is not None:
        b.length = (a.length or 0.0) + (b.length or 0.0)
    return Node(a.name, None, [*a.children, b])


def tips(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.children:
            stack += n.children
        else:
            yield n.name


def masks(root: Node, taxon: dict[str, int]) -> list[tuple[int, Node]]:
    """(mask of taxa below, node) for all nodes, children before parents; bit i stands for taxon i + 1."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.children
    below: dict[int, int] = {}
    out = []
    for n in reversed(order):
        if n.children:
            below[id(n)] = 0
            for c in n.children:
                below[id(n)] |= below[id(c)]
        elif n.name not in taxon:
            raise TreeError(f"unknown taxon {n.name!r}")
        else:
            below[id(n)] = 1 << (taxon[n.name] - 1)
        out.append((below[id(n)], n))
    return out


def write(node: Node, digits: int = 20) -> str:
    def label(n: Node) -> str:
        name = n.name if re.fullmatch(r"[^\s(),:;\[\]']*", n.name) else "'" + n.name.replace("'", "''") + "'"
        return name + (f":{n.length:.{digits}f}" if n.length is not None else "")

    parts: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.children:
            stack.append(")" + label(n))
            for k, child in enumerate(reversed(n.children)):
                stack += [",", child] if k else [child]
            stack.append("(")
        else:
            parts.append(label(n))
    return "".join(parts) + ";"


def taxa(trees: DataFrame) -> DataFrame:
    """(taxon_id, name): the first tree's taxa by name. Taxa of one tree are few enough to be ordered together."""
    first = trees.orderBy("tree_id").limit(1)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for newick in batch["newick"]:
                found = sorted(tips(parse(newick)))
                if len(set(found)) < len(found):
                    raise TreeError("a taxon occurs twice")
                yield pd.DataFrame({"taxon_id": range(1, len(found) + 1), "name": found})

    return first.mapInPandas(names, "taxon_id int, name string")


def splits(trees: DataFrame, taxon: dict[str, int]) -> DataFrame:
    """(tree_id, split_key, length, label): the inner edges of all trees, for at most 62 taxa; taxon 1 is on side 0. A tree is a task's
    row; nothing is collected. Rows whose newick is null give none."""
    if len(taxon) > 62:
        raise TreeError("keys of one number hold at most 62 taxa")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree_id, newick in zip(batch["tree_id"], batch["newick"], strict=True):
                if newick is None:
                    continue
                found = masks(unrooted(parse(newick)), taxon)
                full = found[-1][0]
                low = full & -full
                for mask, node in found[:-1]:
                    key = full ^ mask if mask & low else mask
                    if 2 <= key.bit_count() <= full.bit_count() - 2:
                        rows.append((tree_id, key, node.length, node.name or None))
            yield pd.DataFrame(rows, columns=["tree_id", "split_key", "length", "label"])

    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {trees.schema['tree_id'].dataType.simpleString()}, split_key long, length double, label string")


def nodes(trees: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id, name, length, n_children) of all trees; the root has node_id 0 and no parent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree_id, newick in zip(batch["tree_id"], batch["newick"], strict=True):
                if newick is None:
                    continue
                stack, k = [(parse(newick), None)], 0
                while stack:
                    n, parent = stack.pop()
                    rows.append((tree_id, k, parent, n.name or None, n.length, len(n.children)))
                    stack += [(c, k) for c in reversed(n.children)]
                    k += 1
            yield pd.DataFrame(rows, columns=["tree_id", "node_id", "parent_id", "name", "length", "n_children"]).astype({"parent_id": "Int32"})

    kind = trees.schema["tree_id"].dataType.simpleString()
    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {kind}, node_id int, parent_id int, name string, length double, n_children int")


def tree_lengths(node: DataFrame) -> DataFrame:
    """(tree_id, length): the sum of all branch lengths."""
    return node.groupBy("tree_id").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("length"))


def nested(keys: list[tuple[int, str]], names: list[str]) -> str:
    """Newick of compatible splits (mask, label), the root holding what no split holds."""
    order = sorted(keys, key=lambda k: k[0].bit_count())
    groups: list[tuple[int, str]] = [(1 << i, n) for i, n in enumerate(names)]
    for mask, label in order:
        inside = [g for g in groups if g[0] & mask == g[0]]
        groups = [g for g in groups if g[0] & mask != g[0]]
        groups.append((mask, f"({','.join(t for _, t in inside)}){label}"))
    return f"({','.join(t for _, t in groups)});"


def consensus_newick(consensus: DataFrame, names: list[str], n_trees: int) -> DataFrame:
    """One row: newick, the consensus splits (split_key, n_trees) nested by inclusion, with supports. A consensus has fewer splits than
    taxa, so one task nests them."""
    rows = consensus.select("split_key", "n_trees").groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(F.struct("split_key", "n_trees"))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [nested([(r["split_key"], f":1.0[{int(0.5 + 100 * r['n_trees'] / n_trees)}]") for r in s], names) for s in batch["s"]]
            yield pd.DataFrame({"newick": out})

    return rows.mapInPandas(run, "newick string")
