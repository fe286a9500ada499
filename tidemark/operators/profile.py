"""Column profiles in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """A row for each column: column_name, rows, nulls, distinct_values, low, high (as text).

    ``approximate`` counts distinct values with HyperLogLog, which shuffles a
    sketch for each task instead of the values.
    """
    columns = columns or [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    parts = []
    for at, c in enumerate(columns):
        x = F.col(f"`{c}`")
        parts += [F.count_if(x.isNull()).alias(f"n{at}"), distinct(x).alias(f"d{at}"), F.min(x).cast("string").alias(f"l{at}"), F.max(x).cast("string").alias(f"h{at}")]
    row = df.agg(F.count("*").alias("rows"), *parts)
    out = [F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n{at}").alias("nulls"), F.col(f"d{at}").alias("distinct_values"), F.col(f"l{at}").alias("low"), F.col(f"h{at}").alias("high")) for at, c in enumerate(columns)]
    return row.select(F.explode(F.array(*out)).alias("p")).select("p.*")
