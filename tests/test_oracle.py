"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import __spark_entry__ as entry
import oracle
import pytest

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 120


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "lift" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(spark, name, QUERIES[name], SQL[name], sf, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1
