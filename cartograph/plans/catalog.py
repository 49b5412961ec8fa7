"""Query catalog over the given tables, each with an equivalent SQL text where SQL can say it.

A key maps to ``(query, sql)``. ``query(spark, sf_dir)`` returns a frame with flat columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def register(fn: Query) -> Query:
        CATALOG[name] = (fn, sql)
        return fn

    return register
