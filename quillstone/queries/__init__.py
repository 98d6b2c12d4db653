"""Named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE, QUERIES

for _name in ("filters", "scalars", "aggregates", "stores", "graphs", "lifecycle", "resolution", "retrieval", "ingestion", "outcomes"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE", "QUERIES"]
