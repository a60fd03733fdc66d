"""Every registry query against DuckDB on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from loomgrid import queries
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_without_sql_has_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "entity_id_alias", "orders_o_orderdate", "orders_o_orderkey", "orders_o_totalprice"]


def test_texts_keep_their_own_white_space(spark, tmp_path):
    texts = ["a b", " a", "a ", "\n\ta\r\n", "\u00a0a\u2003", "a\u0085", "\x1ca\x1f", "\u2028a\U0001f600\u3000", "[a]", "]\n", "\n", " \t", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(entry.queries()["q_strip"](spark, str(tmp_path)), duck(str(tmp_path)), queries.oracle_sql()["q_strip"]) is None


def test_latest_is_limited_before_its_shuffle(spark, sf):
    plan = entry.queries()["q_view_current_events"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp" in plan and "props" not in plan
