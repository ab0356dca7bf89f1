"""Every registered query with oracle SQL against DuckDB; the others must run with a stable schema."""

import pytest

from quantloom import catalog
from tests.verify_oracles import compare, connect

ORACLE = catalog.oracle_sql()
QUERIES = catalog.queries()
SLOW = {"optimal_allocations", "return_regressions"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, con, name):
    said = compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
