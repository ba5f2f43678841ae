"""All queries of the core, by name."""

from __future__ import annotations

import importlib

MODULES = ("problems", "pairing", "anchors", "temporal", "quality", "metrics", "describe", "labels", "suites")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"{__package__}.{name}"), what)
        if clash := out.keys() & part.keys():
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
