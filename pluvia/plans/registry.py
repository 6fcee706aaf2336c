"""Registry of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from pluvia.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: Sequence[str] = (), sql: str | None = None):
    """Register a query; ``sql`` is its oracle over the given tables and the named views."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(list(views), sql) if views else sql.strip()
        return fn

    return register
