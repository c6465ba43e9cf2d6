"""Queries for each operator over cubes derived from the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name (or another) with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from terracell.queries import axes, catalogs, reductions, regridding, stores, subsets, valuing  # noqa: F401

    return QUERIES, ORACLE_SQL
