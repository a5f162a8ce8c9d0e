"""Every query of the subpackage that has SQL, against DuckDB over the smallest test data."""

import os
import sys
from pathlib import Path

import pytest

from quillon.llm.queries import oracle_sql, queries

sys.path.insert(0, str(Path(__file__).parents[1]))
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from test_queries import rows

    got = queries()[name](spark, D).toPandas()
    if name in oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(D):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
        expected = con.sql(oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
    else:
        assert len(got.columns)
