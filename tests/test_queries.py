"""Every registered query with SQL against DuckDB on the smallest data set."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import close, norm

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(([norm(v) for v in r] for r in df.select(*cols).collect()), key=str)
    if name not in ORACLES:
        return
    rel = duck.execute(ORACLES[name])
    idx = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(([norm(r[i]) for i in idx] for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
def test_entry(spark):
    rows = entry.entry(spark)
    assert {"asof", "ticker", "strategy", "score", "gate_pass"} <= set(rows.columns)
    assert rows.count() > 0 and rows.groupBy("asof", "ticker", "strategy").count().where("count > 1").count() == 0
