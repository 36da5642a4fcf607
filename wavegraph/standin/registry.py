"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavegraph.standin.sql import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register the function under ``name``; ``sql`` may name any view of ``wavegraph.standin.sql``."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_views(sql, extra)
        return function

    return add
