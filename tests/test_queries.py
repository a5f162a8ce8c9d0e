"""Every query that has SQL, against DuckDB over the smallest test data."""

import os

import pandas as pd
import pytest

import __spark_entry__
from quillon.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return repr(round(float(v), 9) + 0.0) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D).toPandas()
    if name in ORACLES:
        expected = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
