"""Queries of the training-data operators against their SQL."""

from __future__ import annotations

import pytest
from oracle import duck_rows, spark_rows

from tessera.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == duck_rows(SQL[name], data)
