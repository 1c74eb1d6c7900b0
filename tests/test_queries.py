"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skein import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    own = sorted(repr([r[c] for c in cols]) for r in df.collect())
    if name not in queries.ORACLES:
        assert own
        return
    out = tables.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert own == sorted(repr([r[names.index(c)] for c in cols]) for r in out.fetchall())
