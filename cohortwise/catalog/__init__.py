"""Named queries over the test tables, each with the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

from cohortwise.catalog.registry import REGISTRY

for _module in ("ingest", "columns", "relational", "monitoring", "selection", "modelling"):
    import_module(f"cohortwise.catalog.{_module}")

__all__ = ["REGISTRY"]
