"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from conftest_shared import matches_oracle
from graphloom import extraction_queries, function_queries, queries, relational_queries  # noqa: F401  register more


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, small, name):
    matches_oracle(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], small)
