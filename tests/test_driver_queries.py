"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from ephysframe.plans.catalog import QUERIES
from harness import compare

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["units", "sessions", "subjects"]
    assert df.count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, name, QUERIES[name], SQL[name], SF)
    assert ok, msg
