"""Named queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "a1_exact_groups"


def register(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where there is one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from . import compound, dedup, merging, parsing, quality, readside, records, text  # noqa: F401


load()
