"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import ORACLE_PRELUDE, Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a function of a Domain under its name; sql goes on from the derived tables unless plain."""

    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql if plain else ORACLE_PRELUDE + sql
        return f

    return add
