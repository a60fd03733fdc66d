"""A small runner of dataflow modules: functions are nodes, parameters are edges."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Iterable
from types import ModuleType
from typing import Any

Flow = ModuleType | str
Flows = Flow | list[Flow]
_PACKAGES: list[str] = ["loomgrid.plans"]


def register_dataflow_package(name):
    """Let modules of a package be named relative to it; packages are tried in order."""
    if name not in _PACKAGES:
        _PACKAGES.append(name)


def resolve_dataflow(flow: Flow) -> ModuleType:
    if isinstance(flow, ModuleType):
        return flow
    names = [f"{p}.{flow}" for p in _PACKAGES]
    for name in names:
        try:
            return importlib.import_module(name)
        except ModuleNotFoundError as e:
            if e.name is None or not name.startswith(e.name):
                raise  # the module is there; something it needs isn't
    raise ValueError(f"There is no dataflow {flow!r}; tried {', '.join(names)}.")


class Dag:
    """The nodes of some modules; those of later modules replace earlier ones. A node runs once
    an execution, and only if what is asked for needs it."""

    def __init__(self, modules: Iterable[ModuleType]):
        self.nodes: dict[str, Callable] = {}
        for m in modules:
            for name, f in vars(m).items():
                if inspect.isfunction(f) and f.__module__ == m.__name__ and not name.startswith("_"):
                    self.nodes[name] = f

    def run(self, targets: list[str], inputs: dict[str, Any]) -> dict[str, Any]:
        done, open_ = dict(inputs), []

        def value(name: str) -> Any:
            if name in done:
                return done[name]
            if name not in self.nodes:
                raise ValueError(f"{name!r} is neither a node nor an input (needed by {' < '.join(reversed(open_)) or 'the caller'}).")
            if name in open_:
                raise ValueError(f"The nodes {open_[open_.index(name):]} need each other.")
            open_.append(name)
            args = {}
            for p in inspect.signature(self.nodes[name]).parameters.values():
                if p.default is p.empty or p.name in done or p.name in self.nodes:
                    args[p.name] = value(p.name)
            open_.pop()
            done[name] = self.nodes[name](**args)
            return done[name]

        return {t: value(t) for t in targets}


def _modules(flows: Flows) -> list[ModuleType]:
    return [resolve_dataflow(f) for f in (flows if isinstance(flows, list) else [flows])]


class ETLSystem:
    """Runs dataflows; keeps no state between runs."""

    def execute(self, dataflows: Flows, final_vars: Any = None, adapters: Any = None, **inputs: Any) -> Any:
        """Values of ``final_vars``, by default each module's ``FINAL_VAR``: bare if one name
        is asked for, by name if a list is. Each adapter sees (name, value) of the results."""
        modules = _modules(dataflows)
        if final_vars is None:
            missing = [m.__name__ for m in modules if not hasattr(m, "FINAL_VAR")]
            if missing:
                raise ValueError(f"{missing[0]} has no FINAL_VAR; say which nodes you want.")
            final_vars = [m.FINAL_VAR for m in modules]
            final_vars = final_vars[0] if len(final_vars) == 1 else final_vars
        names = [final_vars] if isinstance(final_vars, str) else list(final_vars)
        out = Dag(modules).run(names, inputs)
        for adapter in adapters or ():
            for name, value in out.items():
                adapter(name, value)
        return out[final_vars] if isinstance(final_vars, str) else out

    def outputs(self, dataflows: Flows) -> list[str]:
        return list(Dag(_modules(dataflows)).nodes)
