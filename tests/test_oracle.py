"""Every registered query against its DuckDB oracle (row count, column
names, order-insensitive values), as the driver's check does."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE.get(name), con)
    assert r["status"] in ("match", "rows-only"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["class"] for r in rows] and set(df.columns) >= {"class", "count", "pct", "bar", "mean_value"}


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)
