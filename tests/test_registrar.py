"""Manifests through the whole flow, views, export, sessions."""

from __future__ import annotations

import warnings

import pytest
import yaml

from loomgrid import write_safety as W
from loomgrid.plans.dag import ETLSystem, resolve_dataflow
from loomgrid.registrar import Registrar
from loomgrid.registry import Registry
from loomgrid.session import RegistrarSessions, decode_write, encode_write

FARM = """
meal:
  data:
    - description: "  What an animal eats.  "
    - field:
        value: {type: float, nullable: false}
  hay:
    - field:
        kind: {type: str, range: [dry, fresh], default: dry, nullable: false}
        source: {type: entity_ref}
place:
  - component_type
  - field:
      x: {type: float}
      turn: {type: int, time_dimension: true}
barn:
  data:
    - hay: 1 / 4
    - place: {x: 1, turn: 0}
  stall:
    - hay: [{value: 2, kind: rotten, source: barn}, {kind: fresh}]
    - link of: barn
    - tagged
empty_one:
"""


@pytest.fixture(scope="module")
def farm(spark):
    reg = Registrar(spark=spark)
    reg.update(yaml_strings={"farm": FARM})
    return reg


def test_inherited_fields_are_checked(farm):
    bad = {(r.component_type, r.field, r.value, r.error_type) for r in farm.get("invalid_field").collect()}
    assert bad == {("hay", "kind", "rotten", "range"), ("hay", "value", None, "nullable")}


def test_views(farm):
    df = farm.view("hay")
    assert df.columns[:2] == ["entity_id", "entity_id.alias"] and set(df.columns[2:]) == {"hay.value", "hay.kind", "hay.source", "hay.source_eid"}
    assert sorted((r["entity_id.alias"], r["hay.value"], r["hay.kind"]) for r in df.collect() if r["hay.value"] is not None) == [("barn", 0.25, "dry"), ("barn.stall", 2.0, "rotten")]
    both = farm.view(["hay.value", "place"])
    assert both.columns == ["entity_id", "entity_id.alias", "hay.value", "place.x", "place.turn"] and both.count() == 1
    with pytest.raises(KeyError):
        farm.view("nothing")
    assert farm.view("tagged", "barn.stall").count() == 1
    with pytest.warns(UserWarning, match="matches 0"):
        assert farm.view("hay", "nowhere").count() == 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert farm.view("hay", ["barn"]).count() == 1


def test_reference_resolves_by_alias(farm):
    row = farm.view("hay.source_eid", "barn.stall").where("`hay.source_eid` is not null").first()
    assert row["hay.source_eid"] == farm.get_entity_id("barn")


def test_descriptions_are_stripped_and_ids_resolve(farm):
    assert farm.get_current_value("description", alias="meal") == "What an animal eats."
    assert farm.get_current_value("nothing") is None
    assert farm.get_entity_id("stall") == farm.get_entity_id("barn.stall") and farm.get_entity_id("a") is None
    assert "empty_one" not in {r.entity_key for r in farm.get("entity_id").collect()}


def test_reports(farm):
    text = farm.view_entity("barn")
    assert "## hay" in text and "- value: 0.25" in text and farm.view_entity("nowhere").startswith("No data")
    assert "### hay: 3 rows" in farm.summarize_components(1) and "(2 more)" in farm.summarize_components(1)
    assert "hay.value" in farm.view_entity("barn", "csv")


def test_export_round_trip(farm, tmp_path, spark):
    (path,) = farm.export_manifest(tmp_path)
    data = yaml.safe_load(open(path))
    assert data["barn"]["data"][0] == {"hay": {"value": 0.25, "kind": "dry"}}
    assert "tagged" in data["barn"]["stall"] and {"link of": "barn"} in data["barn"]["stall"]
    again = Registrar(spark=spark)
    again.update(yaml_strings={"farm": open(path).read()})
    kinds = lambda r: {(x.component_type, x.modifier) for x in r.get("component_type").select("component_type", "modifier").collect()}
    assert kinds(again) - {("invalid_field", None)} >= kinds(farm) - {("parent", None)}


def test_updates_over_time(spark, tmp_path):
    reg = Registrar(spark=spark)
    reg.update(yaml_strings={"farm": FARM})
    move = "m:\n  - same_as: farm:barn\n  - place: {x: 5}\n"
    with pytest.raises(ValueError, match="exactly 1"):
        reg.update(yaml_strings={"u": move})
    move = move.replace("same_as: farm:barn", f"same_as: {reg.get_entity_id('barn')}")
    reg.update(yaml_strings={"u": move}, time=3)
    assert reg.view("place").count() == 2
    assert [(r["place.x"], r["place.turn"]) for r in reg.view_current("place").collect()] == [(5.0, 3)]
    reg.update(yaml_strings={"u": move}, time=3)
    assert reg.view("place").count() == 2 and reg.get_current_value("place", "x", "barn") == 5.0
    reg.save(str(tmp_path / "r"))
    back = Registrar.load(str(tmp_path / "r"), spark)
    assert back.view_current("place").count() == 1 and set(back.registry.known_component_types) == set(reg.registry.known_component_types)
    assert "_seq_turn" in back.get("place").columns and "place._seq_turn" not in back.view("place").columns


def test_write_checks(farm):
    assert farm.validate_write("barn:\n  - hay: 3\n") == {"hay"}
    with pytest.raises(ValueError, match="barn.hay"):
        farm.validate_write("barn:\n  hay:\n    - value: 3\n")
    with pytest.raises(ValueError, match="hai.*hay"):
        farm.validate_write("barn:\n  - hai: 3\n")
    assert W.component_types_defined_inline({"n": ["component_type"], "m": [{"component_type": {}}], "data": ["component_type"]}) == {"n"}
    assert W.referenced_component_types({"a": {"data": ["x"], "b": [{"c": 1, "d": 2}, "e"]}}) == {"c", "d", "e"}
    assert W.unknown_component_types("a: [", set()) == {}


class Session:
    pass


def test_sessions(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "farm.yaml").write_text(FARM)
    s, one = RegistrarSessions(lambda r: 9, spark=spark), Session()
    with pytest.raises(ValueError, match="open_registry"):
        s.view_registry(one, "hay")
    assert "hay" in s.open(one, str(tmp_path / "db"), str(tmp_path / "m"), str(tmp_path / "out"))
    text = "calf:\n  - hay: 7\n"
    shown = s.update_registry(one, text, preview=True)
    assert encode_write(text) in shown and "3 rows so far" in shown and decode_write(encode_write(text)) == text
    assert s.update_registry(one, confirm_token=encode_write(text)).startswith("Merged")
    assert "7.0" in s.view_registry(one, "hay") and "calf" in (tmp_path / "out" / "registry" / "session.yaml").read_text()
    with pytest.raises(ValueError, match="confirm_token"):
        s.update_registry(one)
    with pytest.raises(ValueError, match="calf"):
        s.update_registry(one, "calf:\n  hay:\n    value: 3\n")
    assert s.dispatch(one, "open", {}).startswith("Error") and "hay" in s.dispatch(one, "view_entity", {"entity_id": "calf"})
    assert Registrar.load(str(tmp_path / "db"), spark).view("hay").count() == 4


def test_flows(spark, farm):
    with pytest.raises(ValueError, match="no_such"):
        resolve_dataflow("no_such")
    import types

    m = types.ModuleType("flow_m")
    exec("def a(x):\n    return x + 1\ndef b(a, y=2):\n    return a * y\n", m.__dict__)
    assert ETLSystem().execute(m, "b", x=1) == 4 and ETLSystem().execute(m, ["a", "b"], x=1, y=5) == {"a": 2, "b": 10}
    assert ETLSystem().outputs(m) == ["a", "b"]
    with pytest.raises(ValueError, match="FINAL_VAR"):
        ETLSystem().execute(m, x=1)
    with pytest.raises(ValueError, match="needed by"):
        ETLSystem().execute(m, "b")


def test_checks(farm, spark):
    from loomgrid import checks

    assert checks.unexpected_components(farm, "barn", {"hay"}) == {"place"}
    assert checks.write_time(farm, "description", "meal") is None
    assert checks.schema_exists(spark, "default") and not checks.schema_exists(spark, "no_such_schema")


def test_stream_of_manifests(spark, tmp_path):
    import json

    from loomgrid.streaming.updates import merge_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"key": "k", "yaml": "note:\n  - field:\n      at: {type: int, time_dimension: true}\nx:\n  - note: {value: hello}\n"}))
    reg = Registrar(spark=spark)
    texts = spark.readStream.schema("key string, yaml string").json(str(tmp_path / "in"))
    merge_stream(texts, reg, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert [(r["note.value"], r["note.at"]) for r in reg.view("note").collect()] == [("hello", 0)]


def test_registry_of_given_tables(spark):
    reg = Registry(spark)
    assert reg.component_types == [] and "nothing" in reg.summarize_components() and reg.get("x").columns == ["entity_id", "value"]
    reg.update({"t": [{"entity_id": "1", "v": 1}]})
    assert reg.get("t").count() == 1 and reg.known_component_types == ["t"]
    with reg:
        pass
    assert reg.component_types == []
