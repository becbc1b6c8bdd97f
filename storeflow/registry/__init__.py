"""Named queries over the test tables, each with the SQL that gives the same rows.

The modules of this package register their queries on import.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("tables", "rows", "hourly", "features", "forecast", "pos", "sequences", "streams")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, with its SQL where SQL can express it."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = query
        if sql is not None:
            _sql[name] = sql
        return query

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return dict(_queries), dict(_sql)
