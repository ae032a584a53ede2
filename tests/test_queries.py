"""Every registered query with SQL is held against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

from tarnlake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name in ORACLE_SQL:
        want = sorted(repr(r) for r in duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLE_SQL[name]})").fetchall())
        assert got == want
