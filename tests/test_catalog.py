"""Every registered query that SQL can say gives DuckDB's rows."""

import datetime
import math
import os

import duckdb
import pytest

from tabtrust.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL.keys()))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert ours == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns
