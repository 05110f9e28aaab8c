"""The table of registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under its inventory key, with the SQL that has to give the same rows."""
    def add(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return add


def alias(key: str, of: str) -> None:
    QUERIES[key] = QUERIES[of]
    if of in ORACLE:
        ORACLE[key] = ORACLE[of]
