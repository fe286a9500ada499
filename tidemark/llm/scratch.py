"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage and survives lost executors, as ``checkpoint()``
does, but it is columnar and compressed, so it takes far less disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import hadoop_path, new_path, put_text, remove  # noqa: F401


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder now and return the table read back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
