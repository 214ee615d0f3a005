"""Registered queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

ENTRIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        ENTRIES[name] = (f, sql)
        return f

    return keep


def queries() -> dict:
    load()
    return {name: f for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}


def load() -> None:
    """Imports every module of queries."""
    from . import cohort_queries, composed_queries, migration_queries, relational_queries, resolve_queries, serving_queries, timeseries_queries, vector_text_queries  # noqa: F401
