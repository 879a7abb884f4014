"""Each query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusloom.plans import core_queries, core_sql

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for f in glob.glob(f"{WHERE}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.8g}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None))
    return str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core_sql.SQL))
def test_query(spark, duck, name):
    a, b = core_queries.QUERIES[name](spark, WHERE).toPandas(), duck.sql(core_sql.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a.astype(object)) == rows(b.astype(object))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
