"""The corpus queries that SQL can express, against DuckDB over the same tables."""

from __future__ import annotations

import pytest

from loomgrid.llm import queries
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, sf, name):
    assert compare(queries.queries()[name](spark, sf), duck(sf), queries.oracle_sql()[name]) is None
