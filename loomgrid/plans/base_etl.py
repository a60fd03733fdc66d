"""The flow that turns sources into a validated registry."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomgrid.operators import derive as D
from loomgrid.operators import flatten as T
from loomgrid.operators.validate import validate
from loomgrid.registry import Registry
from loomgrid.sources import manifest as S

FINAL_VAR = "validated_registry"


def strings(input_dirs: Any = None, python_strings: Any = None, yaml_strings: Any = None) -> dict:
    return S.raw_strings(input_dirs, python_strings, yaml_strings)


def raw_entity_first_data(strings: dict) -> dict:
    return S.entities(strings)


def raw_csv(spark: SparkSession, input_dirs: Any = None) -> dict[str, DataFrame]:
    return S.csv_files(spark, input_dirs)


def csv_tables(raw_csv: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return S.csv_components(raw_csv)


def pathvalue_pairs(spark: SparkSession, raw_entity_first_data: dict) -> DataFrame:
    return T.path_value_pairs(spark, raw_entity_first_data)


def keyvalue_store(pathvalue_pairs: DataFrame) -> DataFrame:
    return T.key_value_store(pathvalue_pairs)


def entity_id_table(spark: SparkSession, raw_entity_first_data: dict, raw_csv: dict[str, DataFrame]) -> DataFrame:
    return T.entity_spine(T.spine_rows(spark, raw_entity_first_data), S.csv_spine(spark, raw_csv))


def component_type_table(keyvalue_store: DataFrame, csv_tables: dict[str, DataFrame]) -> DataFrame:
    return T.component_metadata(keyvalue_store, csv_tables)


def loaded_registry(spark: SparkSession, keyvalue_store: DataFrame, csv_tables: dict, entity_id_table: DataFrame, component_type_table: DataFrame) -> Registry:
    """The spine and the metadata take the place of component tables of their names."""
    reg = Registry(spark)
    reg.update(T.component_tables(keyvalue_store, csv_tables), lazy=True)
    reg.update({"entity_id": entity_id_table, "component_type": component_type_table})
    return reg


def initial_validated_registry(loaded_registry: Registry, existing_registry: Registry | None = None) -> Registry:
    """Makes flags of the schema real booleans, which derivations rely on."""
    return _validated(loaded_registry, existing_registry)


def derived_registry(initial_validated_registry: Registry, load_time: Any = None, existing_registry: Registry | None = None) -> Registry:
    old = existing_registry.tables if existing_registry else None
    times = existing_registry.time_fields() if existing_registry and load_time is not None else None
    out = Registry(initial_validated_registry.spark, schemas=initial_validated_registry.schemas)
    out.update(D.derive(initial_validated_registry.tables, load_time, old, times), lazy=True)
    return out


def validated_registry(derived_registry: Registry, existing_registry: Registry | None = None) -> Registry:
    """The second validation brings in defaults and constraints of inherited fields."""
    return _validated(derived_registry, existing_registry)


def _validated(reg: Registry, existing: Registry | None) -> Registry:
    tables = {k: t for k, t in reg.tables.items() if k != "invalid_field"}
    done, invalid, declared = validate(tables, existing.tables if existing else None)
    out = Registry(reg.spark)
    out.update({**done, "invalid_field": invalid}, lazy=True)
    for kind, schema in {**reg.schemas, **declared}.items():
        out.declare_schema(kind, schema)
    return out
