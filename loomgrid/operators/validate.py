"""Coercion, defaults and constraints of component tables, by schemas that are data."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, NullType, StringType, StructField, StructType

from loomgrid.functions import coerce
from loomgrid.tables import ENGINE_TYPES, VIOLATION, col, empty

Schemas = dict[str, dict[str, dict[str, Any]]]
TRUE_TEXTS = ("yes", "true", "1")
NUMBERS = ("int", "float", "rating")


def parse_range(text: Any) -> list[str] | None:
    """Allowed values from the text of a list; None if there is no list."""
    if text is None or isinstance(text, list):
        return text if text is None else [str(x) for x in text]
    try:
        found = ast.literal_eval(str(text))
    except (ValueError, SyntaxError):
        return None
    return [str(x) for x in found] if isinstance(found, (list, tuple)) else None


def _flag(value: Any, none: bool) -> bool:
    if value is None:
        return none
    return value.strip().lower() in TRUE_TEXTS if isinstance(value, str) else bool(value)


def build_schemas(types: Iterable[str], fields: list[dict], spine: list[dict]) -> Schemas:
    """Fields of each type: of all entities whose key is the type's name. Rows come in order,
    those of the accumulated registry first, and the first definition of a field counts."""
    by_entity: dict[str, list[dict]] = {}
    for r in fields:
        if r.get("entity_id") is not None and r.get("value"):
            by_entity.setdefault(r["entity_id"], []).append(r)
    owners: dict[str, dict[str, None]] = {}
    for r in spine:
        if r["value"] in by_entity and r["entity_key"] is not None:
            owners.setdefault(r["entity_key"], {})[r["value"]] = None
    out: Schemas = {}
    for kind in types:
        for owner in owners.get(kind, {}):
            for r in by_entity[owner]:
                default = r.get("default")
                out.setdefault(kind, {}).setdefault(r["value"], {"type": r.get("type"), "nullable": _flag(r.get("nullable"), True), "default": default, "range": parse_range(r.get("range"))})
    return out


def coerce_default(value: Any, kind: str) -> Any:
    if kind == "bool":
        return _flag(value, False)
    if kind == "str":
        return str(value)
    try:
        return int(value) if kind == "int" else float(value)
    except (ValueError, TypeError):
        return None


def coerced(df: DataFrame, schema: dict[str, dict[str, Any]]) -> DataFrame:
    """The table with all typed fields: missing ones added, texts resolved and cast, nulls
    replaced by defaults. No row goes and nothing is shuffled."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    # texts whose arithmetic takes Python, which is found out in one scan for all fields
    texts = [n for n, s in schema.items() if s["type"] in NUMBERS and isinstance(have.get(n), StringType)]
    step = "__step"
    while any(c.startswith(step) for c in have):
        step += "_"
    part, easy, text = ({n: f"{step}_{k}{i}" for i, n in enumerate(texts)} for k in "pet")
    split = df
    if texts:
        # step by step, so that no expression is written out, and run, more than once
        split = df.withColumns({part[n]: coerce.arithmetic_parts(col(n)) for n in texts})
        split = split.withColumns({easy[n]: coerce.common_arithmetic(col(part[n])) for n in texts})
        odd = {n: col(part[n]).isNotNull() & col(easy[n]).isNull() for n in texts}
        hard = split.agg(*[F.max(odd[n]) for n in texts]).first()
        python = {text[n]: F.when(odd[n], coerce.arithmetic(col(n))).otherwise(col(n)) for n, hit in zip(texts, hard) if hit}
        split = split.withColumns(python) if python else split
    for name, spec in schema.items():
        kind, default = spec["type"], spec["default"]
        if kind not in ENGINE_TYPES:
            if default is not None and name in have:
                out[name] = F.coalesce(col(name), F.lit(str(default)).cast(have[name] if not isinstance(have[name], NullType) else StringType()))
            continue
        want = ENGINE_TYPES[kind]
        value = col(name) if name in have else F.lit(None)
        source = have.get(name, NullType())
        if isinstance(source, StringType) and not isinstance(want, StringType):
            number = kind in NUMBERS
            value = {"bool": coerce.try_boolean, "int": coerce.try_long}.get(kind, coerce.try_double)(col(text[name]) if number and text[name] in split.columns else value)
            if number:
                found = col(easy[name])
                value = F.when(found.isNotNull(), coerce.rounded(found) if kind == "int" else found).otherwise(value)
        elif isinstance(source, DoubleType) and isinstance(want, LongType):
            value = coerce.round_to_long(value)
        else:
            value = value.cast(want)
        if default is not None and (fill := coerce_default(default, kind)) is not None:
            value = F.coalesce(F.nullif(value, F.lit("")) if kind == "str" else value, F.lit(fill).cast(want))
        out[name] = value
    return split.withColumns(out).drop(*[c for c in split.columns if c not in have]) if out else df


def violations(df: DataFrame, kind: str, schema: dict[str, dict[str, Any]]) -> DataFrame | None:
    """Rows for each null that may not be one and each text out of its range; the table is
    read once, whatever the number of constraints."""
    found = []
    for name, spec in schema.items():
        if name not in df.columns:
            continue
        value = col(name)
        if not spec["nullable"]:
            found.append(F.when(value.isNull(), F.struct(F.lit(name).alias("field"), F.lit(None).cast("string").alias("value"), F.lit("nullable").alias("error_type"))))
        if spec["type"] == "str" and spec["range"] is not None:
            allowed = spec["range"]
            out = ~value.isin(*allowed) if allowed else F.lit(True)
            found.append(F.when(value.isNotNull() & out, F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), F.lit("range").alias("error_type"))))
    if not found or not {"entity_id", "component_index"} <= set(df.columns):
        return None
    rows = df.select("entity_id", F.col("component_index").cast("bigint").alias("component_index"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.select("entity_id", "component_index", F.lit(kind).alias("component_type"), "v.field", "v.value", "v.error_type")


def union_violations(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables) if tables else empty(spark, VIOLATION)


def declared_schema(schema: dict[str, dict[str, Any]]) -> StructType:
    """Schema of a type that is declared but has no data; a tag has one field, ``value``."""
    fields = [StructField(n, ENGINE_TYPES.get(s["type"], StringType())) for n, s in schema.items()] or [StructField("value", StringType())]
    return StructType([StructField("entity_id", StringType()), StructField("component_index", LongType()), StructField("modifier", StringType()), *fields])


def rows_of(df: DataFrame | None) -> list[dict]:
    """Schema rows on the driver, in order of path or entity and of index, so that the first
    definition is the same however the rows were partitioned."""
    if df is None:
        return []
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: (str(r.get("path") or r.get("entity_id") or ""), r.get("component_index") or 0, str(r.get("parent_eid") or "")))


def owner_rows(spine: DataFrame | None, *fields: DataFrame | None) -> list[dict]:
    """The spine's rows of the entities that own a field, on the driver; other entities, of
    which there may be any number, stay where they are."""
    owners = [f.select(F.col("entity_id").alias("value")) for f in fields if f is not None]
    if spine is None or not owners:
        return []
    return rows_of(spine.join(reduce(DataFrame.union, owners).distinct(), "value", "left_semi"))


def validate(tables: dict[str, DataFrame], existing: dict[str, DataFrame] | None = None, strict_declared: bool = False) -> tuple[dict[str, DataFrame], DataFrame, dict[str, StructType]]:
    """All tables coerced, their violations, and schemas of declared types without data.

    ``field`` is coerced by its own rows first. Schemas are looked up among the rows of the
    accumulated registry too. Violating rows stay.
    """
    spark = next(iter(tables.values())).sparkSession
    existing = existing or {}
    field = tables.get("field")
    spine = [*owner_rows(existing.get("entity_id"), existing.get("field"), field), *owner_rows(tables["entity_id"], existing.get("field"), field)]
    old = rows_of(existing.get("field"))
    out, found = dict(tables), []
    if field is not None:
        own = build_schemas(["field"], [*old, *rows_of(field)], spine).get("field", {})
        out["field"] = coerced(field, own)
        if (v := violations(out["field"], "field", own)) is not None:
            found.append(v)
    rows = [*old, *rows_of(out.get("field"))]
    declared: set[str] = set()
    if "component_type" in tables:
        meta = tables["component_type"]
        if strict_declared:
            meta = meta.where(F.col("component_type") == "component_type")
        ids = meta.select(F.col("entity_id").alias("value")).distinct()
        declared = {r[0] for r in tables["entity_id"].join(ids, "value").select("entity_key").distinct().collect() if r[0] is not None}
    schemas = build_schemas({*tables, *declared}, rows, spine)
    for kind, df in tables.items():
        if kind == "field":
            continue
        spec = schemas.get(kind, {})
        out[kind] = coerced(df, spec)
        if (v := violations(out[kind], kind, spec)) is not None:
            found.append(v)
    return out, union_violations(spark, found), {k: declared_schema(schemas.get(k, {})) for k in declared if k not in tables}
