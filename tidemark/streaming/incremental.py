"""Loads and aggregates as streams that end when they have caught up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import VersionedTable


def upsert_new_files(spark: SparkSession, folder: str, schema: T.StructType, table: VersionedTable, keys: Sequence[str], checkpoint: str, order_by: str | None = None) -> DataFrame | None:
    """Upsert all files that came since the last call, in micro-batches, and return the table.

    The checkpoint remembers files; a batch that is run again after a failure
    updates the same keys to the same rows.
    """

    def batch(rows: DataFrame, _: int) -> None:
        kept = rows.persist()
        table.upsert(kept, list(keys), order_by)
        kept.unpersist()

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()


def windowed_counts(stream: DataFrame, time_column: str, keys: Sequence[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows of each window and key; rows later than ``late`` are dropped and their windows' state with them."""
    window = F.window(time_column, size, slide) if slide else F.window(time_column, size)
    counts = stream.withWatermark(time_column, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, time_column: str, keys: Sequence[str], gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key: start, end (last event plus the gap) and events; works on batches and streams."""
    out = df.groupBy(F.session_window(time_column, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def to_table(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream until it has read what is there, into an in-memory table; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
