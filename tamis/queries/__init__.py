"""Registered queries over the given tables, each with the SQL that states its expected result."""

from __future__ import annotations

from importlib import import_module

from tamis.queries.registry import QUERIES, SQL

for _module in ("tables", "cleaning", "shaping", "scoring", "costs", "planning", "comparing", "searching"):
    import_module(f"tamis.queries.{_module}")

__all__ = ["QUERIES", "SQL"]
