"""Checks of a manifest text before it is merged."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from typing import Any

import yaml


Names = set[str]


def _parsed(text: str) -> dict:
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


def referenced_component_types(parsed) -> Names:
    """Names in all component lists at any depth."""

    def names(body: Any) -> Iterator[str]:
        if isinstance(body, dict):
            for key, inner in body.items():
                yield from names(inner) if key != "data" else ()
        elif isinstance(body, list):
            for item in body:
                yield from [item] if isinstance(item, str) else [k for k in item if k != "data"] if isinstance(item, dict) else []

    return set(names(parsed))


def component_types_defined_inline(parsed) -> Names:
    """Top-level entities that the same text marks as component types."""
    return {name for name, body in parsed.items() if name != "data" and isinstance(body, list) and "component_type" in [x for x in body if isinstance(x, str)]}


def nested_component_names(text: str, known: Names) -> list[str]:
    """``entity.name`` where a known type stands as a child entity, most likely by mistake."""
    parsed = _parsed(text)
    return [f"{a}.{k}" for a, body in parsed.items() if a != "data" and isinstance(body, dict) for k, v in body.items() if k != "data" and k in known and isinstance(v, list)]


def unknown_component_types(text: str, known: Names) -> dict[str, list]:
    """Names that are neither known nor defined in the text, with up to three close matches."""
    parsed = _parsed(text)
    new = referenced_component_types(parsed).difference(known, component_types_defined_inline(parsed))
    return {n: difflib.get_close_matches(n, sorted(known)) for n in sorted(new)}
