"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL.

A module adds a query with the decorator; the SQL, where there is one, stands
beside it, so that both are read together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL of its result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from skein.plans import aggregation, evaluation, events, functions, licences, relational, streams, udfs, vectors  # noqa: E402, F401
