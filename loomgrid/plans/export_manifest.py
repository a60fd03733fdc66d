"""The flow that turns a registry into nested manifests."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.merge import latest
from loomgrid.registry import Registry
from loomgrid.sources.manifest import builtins_tags
from loomgrid.tables import KEYS, PARENT, col, empty

Tables = dict[str, DataFrame]
FINAL_VAR = "exported_manifest_filepaths"


def _exportable(path: Column) -> Column:
    """Neither built in nor from Python source."""
    mask = ~F.endswith(path, F.lit(".py"))
    for tag in builtins_tags():
        mask &= ~F.startswith(path, F.lit(f"{tag}."))
    return path.isNotNull() & mask


def components(registry: Registry, collapse_time_dimension=True) -> Tables:
    """All tables; those with a time dimension as their latest rows if collapsing."""
    out = {k: latest(t, registry.time_field(k)) if collapse_time_dimension else t for k, t in registry.tables.items()}
    out.setdefault("parent", empty(registry.spark, PARENT))
    return out


def entity_id(components: dict[str, DataFrame]) -> DataFrame:
    return components["entity_id"].where(_exportable(F.col("filepath"))).dropDuplicates(["value"])


def hidden_types(components: dict[str, DataFrame]) -> set[str]:
    """Types that are derived or flagged to stay out of exports."""
    meta = components.get("component_type")
    if meta is None:
        return set()
    return {r[0] for r in meta.where("derived or skip_on_export").select("component_type").distinct().collect()}


def entity_hierarchy(components: dict[str, DataFrame], entity_id: DataFrame) -> DataFrame:
    """(entity_id, parent_eid): the one primary parent, else that of the lowest index."""
    mine = components["parent"].join(entity_id.select(F.col("value").alias("entity_id")), "entity_id", "left_semi")
    primary = F.coalesce(F.col("is_primary"), F.lit(False))
    both = mine.groupBy("entity_id").agg(
        F.count_if(primary).alias("n"), F.min(F.when(primary, F.col("parent_eid"))).alias("p"), F.min(F.struct("component_index", "parent_eid")).alias("f")
    )
    return both.select("entity_id", F.when(F.col("n") == 1, F.col("p")).otherwise(F.col("f.parent_eid")).alias("parent_eid"))


def non_hierarchy_parents(components: dict[str, DataFrame], entity_hierarchy: DataFrame, entity_id: DataFrame) -> DataFrame:
    """Parent rows but the one that places each entity, with the parent's key as value."""
    mine = components["parent"].join(entity_id.select(F.col("value").alias("entity_id")), "entity_id", "left_semi")
    chosen = entity_hierarchy.withColumnRenamed("parent_eid", "__chosen")
    hit = F.coalesce(F.col("parent_eid") == F.col("__chosen"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("entity_id", hit).orderBy("component_index", "parent_eid"))
    rest = mine.join(chosen, "entity_id", "left").withColumns({"__hit": hit, "__rank": rank}).where("not (__hit and __rank = 1)")
    if "value" not in rest.columns:
        keys = components["entity_id"].dropDuplicates(["value"]).select(F.col("value").alias("parent_eid"), F.col("entity_key").alias("value"))
        rest = rest.join(keys, "parent_eid", "left")
    return rest.drop("__chosen", "__hit", "__rank")


def components_for_export(components: dict[str, DataFrame], non_hierarchy_parents: DataFrame) -> dict[str, DataFrame]:
    return {**components, "parent": non_hierarchy_parents}


def export_rows(components_for_export: dict[str, DataFrame], entity_id: DataFrame, hidden_types: set[str]) -> DataFrame:
    """(entity_id, component_index, name, fields): the fields that aren't null of each row, as
    JSON, with the modifier in the name."""
    ids = entity_id.select(F.col("value").alias("entity_id"))
    out = None
    for kind, df in sorted(components_for_export.items()):
        if kind in hidden_types or not {"entity_id", "component_index"} <= set(df.columns):
            continue
        names = [c for c in df.columns if c not in KEYS and not c.endswith("_eid") and not c.startswith("_seq_")]
        modifier = F.nullif(F.col("modifier"), F.lit("")) if "modifier" in df.columns else F.lit(None)
        fields = F.to_json(F.struct(*[F.nanvl(col(c), F.lit(None)).alias(c) if dict(df.dtypes)[c] in ("double", "float") else col(c) for c in names])) if names else F.lit("{}")
        part = df.join(ids, "entity_id", "left_semi").select("entity_id", F.col("component_index").cast("bigint").alias("component_index"), F.concat_ws(" ", F.lit(kind), modifier).alias("name"), fields.alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else empty(entity_id.sparkSession, "entity_id string, component_index bigint, name string, fields string")


def entity_first_data(export_rows: DataFrame) -> dict[str, list[tuple[int, Any]]]:
    """Entries by entity. A row without fields, or with only an empty value, is a tag."""
    out: dict[str, list[tuple[int, Any]]] = {}
    for r in sorted(export_rows.collect(), key=lambda r: (r.entity_id, r.component_index, r.name, r.fields)):
        fields = json.loads(r.fields)
        out.setdefault(r.entity_id, []).append((r.component_index, r.name if fields in ({}, {"value": ""}) else {r.name: fields}))
    return out


def condensed_entity_first_data(entity_first_data: dict) -> dict[str, list[tuple[int, Any]]]:
    """Entries whose one field is ``value`` become that value."""

    def short(entry: Any) -> Any:
        if isinstance(entry, dict):
            ((name, fields),) = entry.items()
            if list(fields) == ["value"]:
                return {name: fields["value"]}
        return entry

    return {e: [(i, short(x)) for i, x in entries] for e, entries in entity_first_data.items()}


def hierarchical_entity_first_data(condensed_entity_first_data: dict, entity_id: DataFrame) -> dict[str, dict]:
    """Nested mappings by file. An entity with children has its components under ``data``."""
    files: dict[str, dict[tuple[str, ...], list]] = {}
    for r in entity_id.collect():
        names = tuple(r.path[len(r.filepath) + 1 :].split("."))
        files.setdefault(r.filepath, {})[names] = [x for _, x in condensed_entity_first_data.get(r.value, [])]

    def nest(all_: dict[tuple[str, ...], list], below: tuple[str, ...]) -> Any:
        depth = len(below)
        children = dict.fromkeys(k[depth] for k in sorted(all_, key=lambda k: (len(k), k)) if len(k) > depth and k[:depth] == below)
        own = all_.get(below)
        if not children:
            return own
        return ({"data": own} if own else {}) | {c: nest(all_, (*below, c)) for c in children}

    return {f: nest(entities, ()) for f, entities in files.items()}


def exported_manifest_filepaths(hierarchical_entity_first_data: dict, output_dir: str | None = "", overwrite_other_sources: bool = False) -> list[str]:
    """Write a YAML file for each source and return their paths. Without a folder they go where
    they came from; a source that isn't YAML, as a CSV file, is written over only if asked."""
    out = []
    for name, data in hierarchical_entity_first_data.items():
        path = Path(output_dir) / f"{Path(name).stem}.yaml" if output_dir else Path(name)
        if not output_dir and path.suffix not in (".yaml", ".yml") and path.suffix and not overwrite_other_sources:
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True))
        out.append(str(path))
    return sorted(out)
