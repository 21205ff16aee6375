import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con
