"""Registry of runnable queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docskein.plans.fixtures import Tables, oracle
from docskein.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``; ``sql`` is the DuckDB statement over ``views``."""
    names = tuple(views.split()) if isinstance(views, str) else tuple(views)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), fn(Tables(spark, sf_dir)))[1]
        if sql is not None:
            ORACLES[name] = oracle(names, sql)
        return fn

    return register


def stamp(column: str) -> str:
    """DuckDB text form of a timestamp, equal to Spark's ``date_format`` used in the registered queries."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
