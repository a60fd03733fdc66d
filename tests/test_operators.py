"""Validation, derivation and merge on small tables."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid import tables as tb
from loomgrid.functions import coerce
from loomgrid.operators import derive as D
from loomgrid.operators import merge as M
from loomgrid.operators import validate as V


@pytest.mark.parametrize(("text", "want"), [("4 / 50", "0.08"), ("(1 + 2) * -3", "-9.0"), ("1e3", "1e3"), ("abc", "abc"), ("1 / 0", "1 / 0"), ("2024-10-12", "2002.0"), ("2024-01-01", "2024-01-01"), ("True", "1.0"), ("f(1)", "f(1)"), ("", ""), (None, None), ("2 ** 9", "2 ** 9")])
def test_arithmetic(text, want):
    assert coerce.resolve_arithmetic(text) == want


@given(st.text(alphabet="0123456789+-*/(). ", max_size=12))
def test_arithmetic_never_fails(text):
    assert isinstance(coerce.resolve_arithmetic(text), str)


def test_coercions(spark):
    texts = ["3.7", "2.5", "-2.5", "1e3", "1_000", " 7 ", "", "abc", "nan", "inf", "1d", "9223372036854775807", "9007199254740993", "1e30", "true", " true ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(coerce.try_long(F.col("t")), coerce.try_double(F.col("t")), coerce.try_boolean(F.col("t"))).collect()
    assert [r[0] for r in rows] == [4, 3, -3, 1000, 1000, 7, None, None, None, None, None, 9223372036854775807, 9007199254740993, None, None, None, None]
    assert [r[1] for r in rows[:6]] == [3.7, 2.5, -2.5, 1000.0, 1000.0, 7.0] and rows[10][1] is None and rows[9][1] == float("inf")
    assert rows[14][2] is True and rows[15][2] is None


def spec(kind=None, nullable=True, default=None, range=None):
    return dict(type=kind, range=range, default=default, nullable=nullable)


def test_validation_keeps_rows_and_reports(spark):
    df = spark.createDataFrame([("a", 0, "1 / 4", "wet", ""), ("b", 1, "x", "odd", "k"), ("c", 2, None, None, None)], "entity_id string, component_index bigint, n string, kind string, s string")
    s = {"n": spec("float", False), "kind": spec("str", True, None, ["wet", "dry"]), "s": spec("str", True, "none"), "new": spec("bool", True, "yes")}
    out = V.coerced(df, s)
    assert [(r.n, r.kind, r.s, r.new) for r in out.orderBy("entity_id").collect()] == [(0.25, "wet", "none", True), (None, "odd", "k", True), (None, None, "none", True)]
    bad = V.violations(out, "t", s).collect()
    assert {(r.entity_id, r.field, r.value, r.error_type) for r in bad} == {("b", "n", None, "nullable"), ("c", "n", None, "nullable"), ("b", "kind", "odd", "range")}


def test_numbers_round_half_even_texts_away(spark):
    df = spark.createDataFrame([(2.5, "2.5")], "x double, t string")
    r = V.coerced(df, {"x": spec("int"), "t": spec("int")}).first()
    assert (r.x, r.t) == (2, 3)


def test_schema_first_definition_counts():
    rows = [{"entity_id": "1", "value": "f", "type": "int", "range": "['a', 'b']"}, {"entity_id": "2", "value": "f", "type": "str"}, {"entity_id": "2", "value": "g", "nullable": "false"}]
    spine = [{"value": "1", "entity_key": "t"}, {"value": "2", "entity_key": "t"}]
    got = V.build_schemas(["t", "u"], rows, spine)
    assert got["t"]["f"]["type"] == "int" and got["t"]["f"]["range"] == ["a", "b"] and got["t"]["g"]["nullable"] is False and "u" not in got


FIELD = "entity_id string, component_index bigint, value string, description string"
PARENT = "entity_id string, component_index bigint, modifier string, parent_eid string, is_primary boolean"


def inherit_both(spark, fields, parents):
    f = [dict(zip(("entity_id", "component_index", "value", "description"), x)) for x in fields]
    p = [dict(zip((f.split()[0] for f in PARENT.split(", ")), x)) for x in parents]
    driver = {(r["entity_id"], r["component_index"], r["value"], r["description"]) for r in D.inherited_fields(f, p)}
    joins = {tuple(r) for r in D.inherit_by_joins(spark.createDataFrame(fields, FIELD), spark.createDataFrame(parents, PARENT)).collect()}
    return driver, joins


def test_inheritance_nearest_wins_and_cycles_end(spark):
    fields = [("a", 0, "x", "ax"), ("b", 0, "x", "bx"), ("b", 1, "y", "by"), ("c", 5, "z", "cz"), ("c", 6, "y", "cy")]
    parents = [("a", -1, None, "b", True), ("b", -1, None, "c", True), ("c", -1, None, "a", True), ("d", -1, None, "a", True)]
    driver, joins = inherit_both(spark, fields, parents)
    assert driver == joins
    assert {r for r in driver if r[0] == "a"} == {("a", 0, "x", "ax"), ("a", 1, "y", "by"), ("a", 2, "z", "cz")}
    assert {r[2] for r in driver if r[0] == "d"} == {"x", "y", "z"} and ("c", 7, "x", "ax") in driver


def test_hierarchy_and_explicit_parents(spark):
    spine = spark.createDataFrame([("1", "f:a", "a", "a", "f"), ("2", "f:a.b", "a.b", "b", "f"), ("3", "g:k", "k", "k", "g")], tb.SPINE)
    named = spark.createDataFrame([("3", 4, None, "a"), ("3", 5, None, "none")], "entity_id string, component_index bigint, modifier string, value string")
    from loomgrid.ids import dhash

    got = {tuple(r) for r in D.all_parents(spine, named).collect()}
    assert got == {("2", -1, None, dhash("f:a"), True), ("3", 4, None, "1", False)}


def same(spark, rows, spine):
    s = spark.createDataFrame(spine, "value string, path string, alias string, entity_key string, filepath string")
    return {r[0]: r[1] for r in D.same_as_targets(spark.createDataFrame(rows, "entity_id string, value string, target_entity_id string"), s, s).collect()}


def test_same_as(spark):
    spine = [("1", "f:box", "box", "box", "f"), ("2", "s:new", "new", "new", "s"), ("3", "f:bag", "bag", "bag", "f")]
    assert same(spark, [("2", "box", None)], spine) == {"2": "1"}
    assert same(spark, [("2", "box", "3")], spine) == {"2": "3"}
    for rows in ([("2", "f:", None)], [("2", "gone", None)], [("2", None, "9")], [("2", None, None)]):
        with pytest.raises(ValueError, match="same_as"):
            same(spark, rows, spine)


def test_time(spark):
    df = spark.createDataFrame([("a", None), ("b", 3)], "entity_id string, turn bigint")
    got = D.fill_time({"p": df}, 7, {"p": "turn"})["p"]
    assert {tuple(r) for r in got.collect()} == {("a", 7), ("b", 3)}
    with pytest.raises(ValueError, match="more than one"):
        D.time_fields([{"entity_id": "1", "value": v, "time_dimension": True} for v in "xy"], [{"value": "1", "entity_key": "t"}])


def test_merge_aligns_and_is_idempotent(spark):
    a = spark.createDataFrame([("e", 0, "x")], "entity_id string, component_index bigint, v string")
    b = spark.createDataFrame([("e", 0, "x", None), ("f", 0, "y", 1)], "entity_id string, component_index bigint, v string, w bigint")
    once = M.merge_plain(a, b)
    assert once.columns == ["component_index", "entity_id", "v", "w"] and once.count() == 2
    assert M.merge_plain(once, b).count() == 2
    with pytest.raises(ValueError, match="'v'"):
        M.merge_plain(a, a.withColumn("v", F.lit(1.0)))


def test_sequence_and_latest(spark):
    cols = "entity_id string, component_index bigint, t bigint, v string"
    one = M.initial_sequence(spark.createDataFrame([("a", 0, 1, "p"), ("b", 0, None, "q")], cols), "_seq_t")
    two = M.merge_with_sequence(one, spark.createDataFrame([("a", 0, 1, "p"), ("a", 1, 1, "r"), ("b", 0, None, "q")], cols), "_seq_t")
    assert {(r.entity_id, r.v, r._seq_t) for r in two.collect()} == {("a", "p", 1), ("b", "q", 2), ("a", "r", 3)}
    assert {(r.entity_id, r.v) for r in M.latest(two, "t").collect()} == {("a", "r"), ("b", "q")}


def test_many_rows_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "ONE_PARTITION_ROWS", 10)
    df = spark.range(500).select(F.col("id").cast("string").alias("entity_id"), (F.col("id") % 3).alias("component_index"))
    got = [r.s for r in M.numbered(df, "s", 5, ["entity_id", "component_index"]).orderBy("entity_id", "component_index").collect()]
    assert got == list(range(5, 505))


def test_null_types(spark):
    df = spark.sql("select 1 as a, null as b, null as c")
    from pyspark.sql.types import LongType, StructField, StructType

    assert dict(tb.without_null_types(df, StructType([StructField("b", LongType())])).dtypes) == {"a": "int", "b": "bigint", "c": "string"}
