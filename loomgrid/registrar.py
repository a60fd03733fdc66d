"""The facade: load manifests into a registry, look at it, save and export it."""

from __future__ import annotations

from types import ModuleType
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession

from loomgrid import write_safety
from loomgrid.plans import base_etl
from loomgrid.plans.dag import ETLSystem, resolve_dataflow
from loomgrid.registry import Registry
from loomgrid.sources import store


Frames = dict[str, pd.DataFrame]


def default_session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Registrar:
    """A registry that grows by updates, each run through the whole flow."""

    def __init__(self, registry: Registry | None = None, spark: SparkSession | None = None):
        self._registry = registry or Registry(spark or default_session())
        self._registry.spark.conf.set("spark.sql.caseSensitive", "true")  # fields may differ by case alone
        self._etl = ETLSystem()
        self._flows: list[ModuleType] = []

    @classmethod
    def from_manifest(cls, input_dirs: Any, time: Any = None, spark: SparkSession | None = None) -> Registrar:
        out = cls(spark=spark)
        out.load_manifest(input_dirs, time)
        return out

    @classmethod
    def load(cls, url: str, spark: SparkSession | None = None, **options: Any) -> Registrar:
        return cls(store.load(spark or default_session(), url, **options))

    def save(self, url: str, **options: Any) -> None:
        store.save(self._registry, url, **options)

    def load_manifest(self, input_dirs: Any, time: Any = None) -> None:
        self.update(input_dirs, time)

    def base_etl_module(self) -> ModuleType:
        """The flow of ``update``; a subclass may have its own."""
        return base_etl

    def update(self, input_dirs: Any = None, time: Any = None, **inputs: Any) -> None:
        """Merge files, folders and texts (``yaml_strings``, ``python_strings``). ``time``
        fills time dimensions of the new rows that are null."""
        batch = self._etl.execute(self.base_etl_module(), existing_registry=self._registry, spark=self._registry.spark, load_time=time, input_dirs=input_dirs or (), **inputs)
        self._registry.merge(batch)

    def validate_write(self, yaml_string) -> set[str]:
        """Component types a text refers to. Raises if one stands as a child entity or isn't known."""
        known = set(self._registry.known_component_types)
        if nested := write_safety.nested_component_names(yaml_string, known):
            raise ValueError(f"These are component types but stand as child entities; a leading '- ' is missing: {', '.join(nested)}.")
        if unknown := write_safety.unknown_component_types(yaml_string, known):
            texts = [f"{n} (did you mean: {', '.join(near)}?)" if near else n for n, near in unknown.items()]
            raise ValueError(f"Unknown component types: {'; '.join(texts)}. Define them first, as top-level entities with component_type and field.")
        found = yaml.safe_load(yaml_string)
        return set() if not isinstance(found, dict) else write_safety.referenced_component_types(found)

    def overwrite(self, component_type: str, table: Any) -> None:
        self._registry.update({component_type: table})

    def export_manifest(self, output_dir: Any = None, collapse_time_dimension=True) -> list[str]:
        return self._etl.execute("export_manifest", registry=self._registry, output_dir=str(output_dir or ""), collapse_time_dimension=collapse_time_dimension)

    def load_dataflow(self, flow: ModuleType | str) -> None:
        """Make the nodes of a flow available to ``execute``."""
        module = resolve_dataflow(flow)
        if module not in self._flows:
            self._flows.append(module)

    def execute(self, final_vars: Any, **inputs: Any) -> Any:
        """Values of nodes of the loaded flows; of all of them if a flow is named."""
        if isinstance(final_vars, str):
            try:
                self.load_dataflow(final_vars)
                final_vars = self.outputs
            except ValueError:
                final_vars = [final_vars]
        return self._etl.execute(self._flows, final_vars, registry=self._registry, **inputs) if final_vars else {}

    @property
    def registry(self) -> Registry:
        """The tables themselves."""
        return self._registry

    @property
    def outputs(self) -> list[str]:
        """Nodes of the loaded flows."""
        return self._etl.outputs(self._flows)

    def view(self, *args: Any, **kw: Any) -> DataFrame:
        return self._registry.view(*args, **kw)

    def view_current(self, *args: Any, **kw: Any) -> DataFrame:
        return self._registry.view_current(*args, **kw)

    def get_current_value(self, *args: Any, **kw: Any) -> Any:
        return self._registry.get_current_value(*args, **kw)

    def view_df(self, *args: Any, **kw: Any) -> pd.DataFrame:
        return self._registry.view_df(*args, **kw)

    def summarize_components(self, limit: int = 20) -> str:
        return self._registry.summarize_components(limit)

    def get_entity_id(self, ref: str) -> str | None:
        return self._registry.get_entity_id(ref)

    def view_entity(self, *args: Any, **kw: Any) -> str:
        return self._registry.view_entity(*args, **kw)

    def view_entity_df(self, ref: str) -> Frames:
        return self._registry.view_entity_df(ref)

    def get(self, component_type: str) -> DataFrame:
        return self._registry.get(component_type)
