"""Where query modules register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Add a function (spark, sf_dir) -> DataFrame under its own or the given name."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def sql_query(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """Register a Spark SQL query over named tables; the oracle is the same text unless dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(text)

    register(oracle or text, name)(run)
