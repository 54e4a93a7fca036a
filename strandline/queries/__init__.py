"""The registered queries, their checks in plain SQL, and the flagship query."""

from __future__ import annotations

from importlib import import_module

MODULES = ["graph", "staleness", "versions", "history", "files", "summary", "trees", "validation", "layout", "search",
           "markup", "manuscript"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"strandline.queries.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
