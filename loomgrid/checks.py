"""Checks of what a registry holds, for tests of programs that write to one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgrid.registrar import Registrar
from loomgrid.tables import col

ALWAYS_THERE = {"entity_id", "component_type", "parent", "field", "invalid_field", "derived_field"}


def schema_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def unexpected_components(registrar: Registrar, alias: str, expected: Iterable[str]) -> set[str]:
    return set(registrar.view_entity_df(alias)).difference(expected, ALWAYS_THERE)


def write_time(registrar: Registrar, component_type: str, ref: str) -> float | None:
    """The greatest time of an entity's rows, whatever their order."""
    top = registrar.view(component_type, ref).agg(F.max(col(f"{component_type}.time"))).first()[0]
    return None if top is None else float(top)
