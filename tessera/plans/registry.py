"""The queries over the observation model, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows where SQL can express it."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return add


def sql_query(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query that is one SQL text over tables and views of the model; `duck` where the dialects differ."""
    from .observations import duck_sql, run_sql

    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLES[name] = duck_sql(duck or sql)
