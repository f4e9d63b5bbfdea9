"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from modweave.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    return None if v is None else float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    answer = duck.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in answer.fetchall()), key=repr)
