"""Registered queries and their SQL, by area. Every query reads whole tables."""

from __future__ import annotations

import importlib
import pkgutil


def collect() -> tuple[dict, dict]:
    """All queries and all SQL of the modules in this package."""
    queries, sql = {}, {}
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        module = importlib.import_module(f"{__name__}.{m.name}")
        for all_, own in ((queries, getattr(module, "QUERIES", {})), (sql, getattr(module, "SQL", {}))):
            if twice := all_.keys() & own.keys():
                raise ValueError(f"registered twice: {sorted(twice)}")
            all_ |= own
    return queries, sql
