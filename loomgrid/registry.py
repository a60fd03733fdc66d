"""The registry: component tables by type, their merge, and views over them."""

from __future__ import annotations

import math
import warnings
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgrid.ids import candidates
from loomgrid.operators import merge as M
from loomgrid.operators.derive import time_fields
from loomgrid.operators.validate import rows_of
from loomgrid.tables import KEYS, col, empty, settle, without_null_types


Names = str | list[str]
Frames = dict[str, pd.DataFrame]


def format_value(value: Any) -> str:
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return str(value).lower() if isinstance(value, bool) else str(value)


def markdown(columns: list[str], rows: list[tuple]) -> str:
    """A pipe table; nulls as ``null``."""
    cells = [columns, *([format_value(v).replace("|", "\\|").replace("\n", " ") for v in r] for r in rows)]
    width = [max(3, *(len(r[i]) for r in cells)) for i in range(len(columns))]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, cells[1:])])


class Registry:
    """Component tables by type, and schemas of types without data.

    What plans need to know of the schema (time dimensions, the spine's few columns) is read
    once a version of the registry; building a view starts no job after that, unless it
    resolves aliases.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, schemas: dict[str, StructType] | None = None):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.schemas: dict[str, StructType] = {}
        self._times: dict[str, str] | None = None
        for k, t in (tables or {}).items():
            if isinstance(t, DataFrame):
                self.tables[k] = t
        for k, s in (schemas or {}).items():
            self.declare_schema(k, s)

    def __enter__(self) -> Registry:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for t in self.tables.values():
            t.unpersist()
        self.tables = {}

    @property
    def component_types(self) -> list[str]:
        return list(self.tables)

    @property
    def known_component_types(self) -> list[str]:
        return list({**self.tables, **self.schemas})

    def update(self, components: dict[str, Any], lazy: bool = False) -> None:
        """Replace whole tables; a pandas or Arrow table or a list of rows does as well. They
        are settled, unless ``lazy`` as for tables that go on to a next step."""
        for kind, table in components.items():
            df = table if isinstance(table, DataFrame) else self.spark.createDataFrame(table)
            known = self.tables[kind].schema if kind in self.tables else self.schemas.get(kind)
            df = without_null_types(df, known)
            self.tables[kind] = df if lazy else settle(df)
        self._times = None

    def declare_schema(self, kind: str, schema: StructType) -> None:
        if kind not in self.tables:
            self.schemas[kind] = schema

    def get(self, kind: str) -> DataFrame:
        if kind in self.tables:
            return self.tables[kind]
        return empty(self.spark, self.schemas[kind]) if kind in self.schemas else self.spark.createDataFrame([], "entity_id string, value string")

    def time_fields(self) -> dict[str, str]:
        """Time dimension by type; a type with several raises."""
        if self._times is None:
            field = self.tables.get("field")
            if field is None or "entity_id" not in self.tables or "time_dimension" not in field.columns:
                self._times = {}
            else:
                rows = [r for r in rows_of(field.where(F.col("time_dimension").cast("string").isin("true", "True", "1", "yes")))]
                self._times = time_fields(rows, self._spine_of({r["entity_id"] for r in rows}))
        return self._times

    def _spine_of(self, ids: set[str]) -> list[dict]:
        spine = self.tables["entity_id"]
        return rows_of(spine.where(F.col("value").isin(*ids)).select("value", "entity_key")) if ids else []

    def time_field(self, kind: str) -> str | None:
        return self.time_fields().get(kind)

    def merge(self, other: Registry) -> Registry:
        """Take in a batch: new types as they are, others by distinct union over aligned
        columns; types with a time dimension number their new rows in ``_seq_<field>``."""
        times = {**self.time_fields(), **other.time_fields()}
        for kind, df in other.tables.items():
            time = times.get(kind)
            mine = self.tables.get(kind)
            df = without_null_types(df, mine.schema if mine is not None else None)
            mine = None if mine is None else without_null_types(mine, df.schema)
            if time is not None and time in df.columns:
                name = f"_seq_{time}"
                out = M.merge_with_sequence(mine, df, name) if mine is not None else M.initial_sequence(df, name)
            else:
                out = df if mine is None else M.merge_plain(mine, df)
            self.tables[kind] = settle(out)
            self.schemas.pop(kind, None)
        for kind, schema in other.schemas.items():
            self.declare_schema(kind, schema)
        self._times = None
        return self

    # Views

    def view(self, component_type: Names, aliases: Names | None = None) -> DataFrame:
        """Types or ``type.field`` joined on the entity; columns are named ``type.field``."""
        return self._view(component_type, aliases, current=False)

    def view_current(self, component_type: Names, aliases: Names | None = None) -> DataFrame:
        """As ``view``, with the latest row of each entity for types with a time dimension."""
        return self._view(component_type, aliases, current=True)

    def _table(self, kind: str, current: bool) -> DataFrame:
        if kind not in self.tables and kind not in self.schemas:
            raise KeyError(f"Unknown component type {kind!r}.")
        df = self.get(kind)
        return M.latest(df, self.time_field(kind)) if current else df

    def _view(self, wanted: Names, aliases: Names | None, current: bool) -> DataFrame:
        wanted = [wanted] if isinstance(wanted, str) else list(wanted)
        if "entity_id" not in wanted and "entity_id.alias" not in wanted and "entity_id" in self.tables:
            wanted = ["entity_id.alias", *wanted]
        fields: dict[str, list[str]] = {}
        for entry in wanted:
            kind, _, name = (entry, "", "") if entry in self.tables or entry in self.schemas else entry.partition(".")
            df = self._table(kind, False)
            names = [name] if name else [c for c in df.columns if c not in KEYS and not c.startswith("_seq_") and not (kind == "entity_id" and c == "value")]
            if name and name not in df.columns and not (kind == "entity_id" and name == "entity_id"):
                raise KeyError(f"{kind!r} has no field {name!r}.")
            mine = fields.setdefault(kind, [])
            mine += [n for n in names if n not in mine]
        out = None
        for kind, names in fields.items():
            key = "value" if kind == "entity_id" else "entity_id"
            part = self._table(kind, current).select(col(key).alias("entity_id"), *[col(n).alias(f"{kind}.{n}") for n in names if not (kind == "entity_id" and n == "entity_id")])
            out = part if out is None else out.join(part, "entity_id")
        if aliases is not None:
            ids = self._resolve([aliases] if isinstance(aliases, str) else list(aliases))
            if len(ids) > 1000:
                out = out.join(self.spark.createDataFrame([(i,) for i in ids], "entity_id string"), "entity_id", "left_semi")
            else:
                out = out.where(F.col("entity_id").isin(*ids) if ids else F.lit(False))
        return out

    def _candidates(self, ref: str) -> list[str]:
        """Tiers are tried in one scan: the filter reaches the table, and only rows that may
        match come to the driver."""
        if "entity_id" not in self.tables:
            return []
        spine = self.tables["entity_id"]
        name = F.col("alias") == ref if "alias" in spine.columns else F.lit(False)
        return candidates(ref, rows_of(spine.where((F.col("value") == ref) | name | F.contains(F.col("path"), F.lit(ref)))))

    def _resolve(self, refs: list[str]) -> list[str]:
        out: dict[str, None] = {}
        for ref in refs:
            found = self._candidates(ref)
            if len(found) != 1:
                warnings.warn(f"{ref!r} matches {len(found)} entities: {found}", UserWarning, stacklevel=4)
            out.update(dict.fromkeys(found))
        return list(out)

    def get_entity_id(self, ref: str) -> str | None:
        found = self._candidates(ref)
        return found[0] if len(found) == 1 else None

    def get_current_value(self, component_type, field="value", alias: Names | None = None) -> Any:
        if component_type not in self.tables and component_type not in self.schemas:
            return None
        df = self.view_current([component_type], alias)
        name = f"{component_type}.{field}"
        if name not in df.columns:
            return None
        full = self._table(component_type, True)
        rows = full.select("entity_id", *[c for c in ("component_index",) if c in full.columns], col(field)).join(df.select("entity_id").distinct(), "entity_id", "left_semi")
        order = ["entity_id", *(["component_index"] if "component_index" in rows.columns else [])]
        last = rows.orderBy(*[F.col(c).desc() for c in order]).first()
        return None if last is None else last[field]

    # Reports

    def view_df(self, component_type: Names, aliases: Names | None = None) -> pd.DataFrame:
        return self.view(component_type, aliases).toPandas().set_index("entity_id")

    def summarize_components(self, limit=20) -> str:
        """Count and first rows of every type with data, as markdown."""
        if not self.tables:
            return "No component types have any data yet; there is nothing to report."
        out = []
        for kind in sorted(self.tables):
            df = self.view(kind)
            total = df.count()
            rows = df.orderBy(*[col(c) for c in df.columns]).limit(limit).collect()
            text = markdown(df.columns, [tuple(r) for r in rows])
            if total > limit:
                text += f"\n({total - limit} more)"
            out.append(f"### {kind}: {total} rows\n{text}")
        return "\n\n".join(["Component types with data:", *out])

    def view_entity_df(self, ref: str) -> Frames:
        """All components of one entity by type; the id is pushed down to each table."""
        ident = self.get_entity_id(ref)
        out = {}
        for kind in self.tables if ident is not None else ():
            try:
                df = self.view(kind).where(F.col("entity_id") == ident).toPandas()
            except (KeyError, ValueError):
                continue
            if len(df):
                out[kind] = df.set_index("entity_id")
        return out

    def view_entity(self, entity_id, format="markdown") -> str:
        found = self.view_entity_df(entity_id)
        if not found:
            return f"No data for {entity_id!r}."
        if format != "markdown":
            return "\n\n".join(f"# {kind}\n\n{df.to_csv()}" for kind, df in found.items())
        lines = [f"# {entity_id}"]
        for kind, df in found.items():
            for values in df.to_dict("records"):
                lines.append(f"\n## {kind}")
                lines += [f"- {k.removeprefix(kind + '.')}: {format_value(v)}" for k, v in values.items() if k != "entity_id.alias"]
        return "\n".join(lines)
