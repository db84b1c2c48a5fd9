"""Core queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from webloom import queries as core

FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SQL = core.oracle_sql()


def values(df):
    import pandas as pd

    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "~"
        return f"{float(x):.7g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and type(x).__name__[:3] in ("int", "flo", "uin") else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    got = core.queries()[name](spark, FOLDER)
    if name in SQL:
        want = duck.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got.toPandas()) == values(want)
    else:
        got.count()
