"""Sessions over registrars: reads, and writes that can be previewed before they are merged."""

from __future__ import annotations

import base64
import weakref
from collections.abc import Callable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession

from loomgrid.registrar import Registrar
from loomgrid.registry import markdown
from loomgrid.sources.manifest import malformed_entities
from loomgrid.tables import col

#: Source of all writes of a session, so that an alias keeps its entity.
SOURCE = "session"
SUFFIXES = {".yml", ".yaml"}
TOOLS = ("view_registry", "view_entity", "consolidate_review", "update_registry")
GUIDANCE = "See whether anything above should be brought together: one fact under two names, or under the wrong one. Correct it by a write; else nothing is to be done."


def encode_write(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode()


def decode_write(token: str) -> str:
    return base64.urlsafe_b64decode(token.encode()).decode()


def write_summary(registrar: Registrar, kind: str, limit=3) -> str:
    """Rows a type has so far, and a few of them."""
    try:
        df = registrar.view(kind)
    except KeyError:
        return f"- {kind} is declared, without data so far."
    n = df.count()
    if not n:
        return f"- {kind} is declared, with 0 rows so far."
    rows = df.orderBy(*[col(c) for c in df.columns]).limit(limit).collect()
    return f"- {kind}: {n} rows so far, such as\n{markdown(df.columns, [tuple(r) for r in rows])}"


def checked_write(registrar: Registrar, text: str) -> set[str]:
    parsed = yaml.safe_load(text)
    if isinstance(parsed, dict) and (bad := malformed_entities(parsed)):
        raise ValueError(f"An entity's components must be a list, each with a leading '- '; they are not at: {', '.join(bad)}.")
    return registrar.validate_write(text)


Text = str | None
Clock = Callable[[Registrar], Any]


class RegistrarSessions:
    """One registrar a session. ``time_provider`` gives the time that a write fills in."""

    def __init__(self, time_provider: Clock | None = None, export_dirname="registry", export_history_dirname="registry_history", open_tool_name="open_registry", spark: SparkSession | None = None):
        self._open: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
        self._exports: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
        self._urls: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
        self._time = time_provider or (lambda registrar: None)
        self._dirs = (export_dirname, export_history_dirname)
        self._open_tool = open_tool_name
        self._spark = spark

    def get_registrar(self, session: Any) -> Registrar:
        if session not in self._open:
            raise ValueError(f"This session has no registry open; call {self._open_tool} first.")
        return self._open[session]

    def set_registrar(self, session: Any, registrar: Registrar, export_dir: Any = None) -> None:
        self._open[session] = registrar
        if export_dir:
            self._exports[session] = Path(export_dir)

    def open(self, session: Any, database_url: str, manifest_dir: Any = None, export_dir: Any = None) -> str:
        """Open a saved registry, or a new one filled from a folder of manifests. Writes of the
        session are saved there."""
        registrar = Registrar.load(database_url, self._spark)
        self._urls[session] = database_url
        if manifest_dir and not registrar.registry.component_types:
            files = sorted(f for f in Path(manifest_dir).rglob("*") if f.suffix in SUFFIXES)
            registrar.update(yaml_strings={SOURCE: "\n".join(f.read_text() for f in files)})
            registrar.save(database_url)
        self.set_registrar(session, registrar, export_dir)
        return f"Opened {database_url} with component types {sorted(registrar.registry.component_types)}."

    def view_registry(self, session: Any, component_type: str) -> str:
        df = self.get_registrar(session).view(component_type)
        return markdown(df.columns, [tuple(r) for r in df.collect()])

    def view_entity(self, session: Any, entity_id: str) -> str:
        return self.get_registrar(session).view_entity(entity_id)

    def consolidate_review(self, session: Any, limit: int = 20) -> str:
        return f"{self.get_registrar(session).summarize_components(limit)}\n\n{GUIDANCE}"

    def update_registry(self, session: Any, yaml_string: Text = None, preview=False, confirm_token: Text = None) -> str:
        """Merge a text; or show what it would touch, with a token that merges it later."""
        if confirm_token is not None:
            yaml_string, preview = decode_write(confirm_token), False
        if yaml_string is None:
            raise ValueError("Give yaml_string, or the confirm_token of a preview.")
        registrar = self.get_registrar(session)
        types = checked_write(registrar, yaml_string)
        if preview:
            return "\n".join([
                "Not merged yet. Component types in this write: " + ", ".join(sorted(types)),
                "Component types that are known: " + ", ".join(sorted(registrar.registry.known_component_types)),
                *(write_summary(registrar, t) for t in sorted(types)),
                f"To merge it, call update_registry with this confirm_token:\n{encode_write(yaml_string)}",
            ])
        registrar.update(yaml_strings={SOURCE: yaml_string}, time=self._time(registrar))
        if session in self._urls:
            registrar.save(self._urls[session])
        if session in self._exports:
            self._export(registrar, self._exports[session])
        return "Merged into the registry."

    def dispatch(self, session: Any, name: str, arguments: dict) -> str:
        """A call by name, of the tools alone."""
        return getattr(self, name)(session, **arguments) if name in TOOLS else f"Error: there is no tool {name!r}"

    def _export(self, registrar: Registrar, folder: Path) -> None:
        """Current state and full history, each as the one file of the session's source."""
        for name, collapse in zip(self._dirs, (True, False)):
            for path in registrar.export_manifest(folder / name, collapse):
                if Path(path) != folder / name / f"{SOURCE}.yaml":
                    Path(path).unlink(missing_ok=True)

    def mount(self, server: Any, exclude: tuple[str, ...] = ()) -> None:
        """Offer the tools on a server that has a decorator ``tool`` and gives each call a
        context with its ``session``."""

        def offer(name: str) -> None:
            method = self.open if name == self._open_tool else getattr(self, name)

            def call(ctx: Any, **arguments: Any) -> str:
                return method(ctx.session, **arguments)

            call.__name__, call.__doc__ = name, method.__doc__
            server.tool(name=name)(call)

        for name in (self._open_tool, *TOOLS):
            if name not in exclude:
                offer(name)
