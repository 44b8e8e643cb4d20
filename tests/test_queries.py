import math
import os

import duckdb
import pytest

from clademill import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(rows):
    value = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    assert rows
    if name in catalog.oracle_sql():
        found = db.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
        assert plain(rows) == plain(found)
