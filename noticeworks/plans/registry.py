"""Queries registered by name, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeworks.plans.oracle_views import with_views
from noticeworks.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without `sql` it is tested on fixtures instead."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return add


def stamp(column: str, name: str | None = None):
    """A timestamp as text, so that every engine prints it alike."""
    from pyspark.sql import functions as F

    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss").alias(name or column.split(".")[-1])
