"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .inputs import QUERIES as _ALL

for _name in ("statistics", "indicators", "blocks", "patterns", "shapes", "ingest", "streams", "contracts"):
    import_module(f"{__package__}.{_name}")

QUERIES = {k: q.build for k, q in _ALL.items()}
ORACLES = {k: q.sql for k, q in _ALL.items() if q.sql}
