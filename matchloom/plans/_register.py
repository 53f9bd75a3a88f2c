"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Callable], Callable]:
    """Register ``f(views) -> DataFrame``; ``views`` are the fixture views that the SQL names."""

    def add(f: Callable[[fixtures.Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixtures.with_views(views.split(), sql)
        return f

    return add
