"""Every plan against its SQL in DuckDB; the rest against properties."""

from __future__ import annotations

import pytest
from oracle import duck_rows, spark_rows

from tessera.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_matches_sql(spark, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == duck_rows(SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_plan_without_sql_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
