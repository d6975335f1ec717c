"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
CORE = [k for k in entry.queries() if not (k[0] == "p" and k[1:2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(df):
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    cols = sorted(df.columns)
    return cols, sorted(repr([one(v) for v in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert plain(got) == plain(duck.execute(sql).df())
    assert list(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
