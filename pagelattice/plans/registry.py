"""Queries by name, each with the SQL that answers it in DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelattice.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` is a SELECT over the named views, or more CTEs that start with a comma."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            prefix = with_views(*views.split()).rstrip() if views else ""
            ORACLE[name] = f"{prefix}{sql}" if sql.startswith(",") else f"{prefix} {sql}".strip()
        return f

    return add
