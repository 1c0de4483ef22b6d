"""The queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query; the SQL's shared tables are put before it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            recursive = "RECURSIVE " * sql.startswith(",")  # goes on with a table that refers to itself
            ORACLE_SQL[name] = (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add
