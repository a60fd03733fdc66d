"""What keeps data off the driver, and what Python has no part in."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgrid import tables
from loomgrid.functions import coerce
from loomgrid.ids import hash_column
from loomgrid.operators import derive as D
from loomgrid.operators import validate as V
from loomgrid.registry import Registry
from loomgrid.sources import store


def expressions(n):
    rng = random.Random(4)
    number = lambda: rng.choice([str(rng.randrange(0, 99999)), f"{rng.uniform(0, 1e6):.3f}", f"-{rng.randrange(1, 50)}", "0", "007", "1e3", "1_000", "123456789"])
    for _ in range(n):
        a, b, c, op, op2 = number(), number(), number(), rng.choice("+-*/"), rng.choice("+-*/")
        yield rng.choice([f"{a} {op} {b}", f"{a}{op}{b}", f" ({a} {op} {b}) {op2} {c}", f"{a} {op} {b} {op2} {c}", a, f"{a}d", f"x{a}", f"{a} {op}"])


def test_native_arithmetic_is_that_of_python(spark):
    texts = list(expressions(1500)) + ["1 / 0", "(1 - 1) / 0", "inf", " nan", "1f ", "2.5d\n", "+3", "- 3", "(4)", "True + 1", "0x10 + 1"]
    want = {}
    for x in texts:
        try:
            y = coerce.resolve_arithmetic(x)
            want[x] = None if y.strip().lower()[-1:] in ("d", "f") and not y.strip().lower().endswith("inf") else float(y)
        except ValueError:
            want[x] = None
    df = spark.createDataFrame([(x, x) for x in texts], "x string, v string")
    got = {r.x: r.v for r in V.coerced(df, {"v": {"type": "float", "nullable": True, "default": None, "range": None}}).collect()}
    bad = {x: (got[x], want[x]) for x in got if got[x] != want[x] and not (got[x] is not None and got[x] != got[x] and want[x] != want[x])}
    assert not bad
    easy = df.withColumn("p", coerce.arithmetic_parts(F.col("x"))).where(coerce.common_arithmetic(F.col("p")).isNotNull()).count()
    assert easy > 60


def test_common_shapes_take_no_python(spark):
    df = spark.range(50).select(F.concat(F.col("id").cast("string"), F.lit(" / 4")).alias("v"))
    plan = V.coerced(df, {"v": {"type": "int", "nullable": True, "default": None, "range": None}})
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in plan.limit(3).collect()] == [0, 0, 1]


def test_entities_without_fields_stay_off_the_driver(spark, monkeypatch):
    """A million entities, of which one owns a field."""
    path = F.concat(F.lit("f:e"), F.col("id").cast("string"))
    spine = spark.range(1_000_000).select(hash_column(path).alias("value"), path.alias("path"), path.alias("alias"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_key"), F.lit("f").alias("filepath"))
    owner = spine.where("entity_key = 'e7'").first().value
    field = spark.createDataFrame([(owner, 0, "x", "int", True)], "entity_id string, component_index bigint, value string, type string, time_dimension boolean")
    comp = spine.limit(10).select(F.col("value").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), F.lit("4").alias("x"))
    seen = []
    real = V.rows_of
    monkeypatch.setattr(V, "rows_of", lambda df: seen.append(r := real(df)) or r)
    out, bad, _ = V.validate({"entity_id": spine, "field": field, "e7": comp})
    assert out["e7"].schema["x"].dataType.typeName() == "long" and max(map(len, seen)) == 1
    assert D.owner_rows(spine, field)[0]["entity_key"] == "e7" and len(D.owner_rows(spine, field)) == 1


def test_a_wrong_estimate_does_not_bring_a_table_to_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(1,)], "a int").select(F.explode(F.sequence(F.lit(1), F.lit(60_000))).alias("a"))
    out = tables.settle(df)
    assert out.count() == 60_000 and out.inputFiles()
    assert not tables.settle(df.limit(10)).inputFiles()


def test_inheritance_is_as_deep_by_joins(spark):
    n = 70
    parent = spark.createDataFrame([(f"e{i}", -1, f"e{i + 1}", True) for i in range(n)], "entity_id string, component_index bigint, parent_eid string, is_primary boolean").coalesce(1)
    field = spark.createDataFrame([(f"e{n}", 0, "deep")], "entity_id string, component_index bigint, value string").coalesce(1)
    rows = D.inherited_fields([r.asDict() for r in field.collect()], [r.asDict() for r in parent.collect()])
    got = {(r.entity_id, r.component_index, r.value) for r in D.inherit_by_joins(field, parent).collect()}
    assert got == {(r["entity_id"], r["component_index"], r["value"]) for r in rows} and len(got) == n + 1


def test_saves_are_numbered_and_a_reader_always_finds_one(spark, tmp_path, monkeypatch):
    url = str(tmp_path / "reg")
    for i in range(6):
        store.save(Registry(spark, {"a": spark.createDataFrame([(i,)], "v int")}), url)
        assert [r.v for r in store.load(spark, url).get("a").collect()] == [i]
    assert len(list((tmp_path / "reg").glob("registry-*.json"))) == store.KEPT + 1
    monkeypatch.setattr(store, "_versions", lambda s, f: [(5, f"{f}/registry-000000005.json")])
    with pytest.raises(RuntimeError, match="came between"):
        store.save(Registry(spark, {"a": spark.createDataFrame([(9,)], "v int")}), url)
    monkeypatch.undo()
    assert [r.v for r in store.load(spark, url).get("a").collect()] == [5]


def test_all_tables_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    reg = Registry(spark, {"place": spark.createDataFrame([("e", 1.5)], "entity_id string, x double"), "Tag": spark.createDataFrame([("e", 2)], "entity_id string, n int")})
    store.save(reg, url)
    back = store.load(spark, url)
    assert set(back.component_types) == {"place", "Tag"} and back.get("place").collect()[0].x == 1.5
    assert set(store.load(spark, url, ["Tag"]).component_types) == {"Tag"}
