"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; the scan prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables for spark.sql()."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
