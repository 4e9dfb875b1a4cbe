"""Registered queries of the vector engine and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query (spark, sf_dir) -> DataFrame and, if given, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from vectorloom.queries import clusters, distances, indexes, neighbors  # noqa: F401
