"""As-of joins: each row with the last row of another table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, slices: int = 64) -> DataFrame:
    """left with a struct column ``right``: the last row of right with the same ``by`` at or before ``time``, or null.

    Both are put in one order by key and time, so nothing is multiplied as in a
    join by inequality.  A key's time is cut into ``slices`` of equal length
    between its first and last right row, so that a hot key is many tasks'
    work; what a slice begins with comes from a row per key and slice.  Rows with
    a null key or time have no partner.  Of right rows with equal key and time
    the largest is taken.  Columns named _side, _r, _slice, _first, _last, _before and right must be free.
    """
    keys = [F.col(k) for k in by]
    at = F.unix_micros(F.col(time).cast("timestamp"))
    bounds = right.filter(F.col(time).isNotNull()).groupBy(*by).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    whole = F.struct(*[F.col(c) for c in right.columns])
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(whole.alias("r")).schema["r"].dataType).alias("_r"))
    others = right.filter(F.col(time).isNotNull()).select(*[F.col(c) if c in (*by, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), whole.alias("_r"))
    both = rows.unionByName(others).join(bounds, list(by), "left")
    width = F.greatest(F.lit(1), (F.col("_last").cast("double") - F.col("_first")) / slices)
    part = (at.cast("double") - F.col("_first")) / width
    # what comes after the last right row needs no order: it is dealt anyhow.  Numbers are small enough for an int only then:
    # with a single right row a slice has a microsecond
    place = F.when(part >= slices + 1, slices + 1 + F.pmod(F.xxhash64(at), F.lit(slices))).when(part >= 0, F.floor(part)).cast("int")
    placed = both.withColumn("_slice", place).drop("_first", "_last")
    alone = placed.filter("_side = 1 AND _slice IS NULL").select(*left.columns, F.col("_r").alias("right"))
    placed = placed.filter("_slice IS NOT NULL")
    per_slice = placed.filter("_side = 0").groupBy(*by, "_slice").agg(F.max(F.struct(F.col(time).alias("t"), F.col("_r").alias("r"))).alias("last"))
    starts = placed.select(*by, "_slice").distinct()
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.join(per_slice, [*by, "_slice"], "left").select(*by, "_slice", F.last("last.r", True).over(earlier).alias("_before"))
    known = F.last("_r", True).over(Window.partitionBy(*keys, "_slice").orderBy(F.col(time), "_side", "_r").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("right", known).filter("_side = 1").join(starts, [*by, "_slice"])
    return found.select(*left.columns, F.coalesce("right", "_before").alias("right")).unionByName(alone)
