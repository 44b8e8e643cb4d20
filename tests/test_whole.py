"""Queries over all rows read what the ranges of ids leave out."""

import pyarrow.parquet as pq
import pytest

from clademill import catalog

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def vectors():
    return pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id"]).num_rows


def test_all_vectors_are_in_the_alignment(spark, vectors):
    cells = rows(spark, "alignment_cells_all")
    blocks = -(-vectors // 24)
    assert len(cells) == len({(r["taxon_id"], r["site"]) for r in cells}) == blocks * 24 * 64
    assert sum(r["code"] == 15 for r in cells) == (blocks * 24 - vectors) * 64
    assert sum(r["weight"] for r in rows(spark, "site_patterns_all")) == -(-vectors // 4) * 64


def test_every_vector_is_placed(spark, vectors):
    assert {r["query_id"] for r in rows(spark, "placement_entropy_all")} == set(range(1, vectors + 1))


def test_no_ranges_of_ids():
    """Neither in the SQL of these queries."""
    some = {k: v for k, v in catalog.oracle_sql().items() if k.endswith("_all")}
    assert some and not any("vec_id <" in v or "site > 61" in v or "% 50" in v for v in some.values())


def test_every_order_is_a_tree(spark):
    orders = pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey"])["o_orderkey"].to_pylist()
    found = rows(spark, "newick_splits_all")
    assert {r["tree_id"] for r in found} == set(orders) and len(found) == 2 * len(orders)
