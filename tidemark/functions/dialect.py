"""Functions whose Spark namesakes mean something else than pipelines written for an embedded SQL engine expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(at: Column) -> Column:
    """0 for Sunday to 6 for Saturday (Spark counts from 1)."""
    return F.dayofweek(at) - 1


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of a unit between two times, as bigint: years, quarters, months, weeks (from Monday), days, hours, minutes or seconds."""
    months = lambda c: 12 * F.year(c) + F.month(c)
    if unit == "year":
        out = F.year(end) - F.year(start)
    elif unit == "month":
        out = months(end) - months(start)
    elif unit == "quarter":
        out = 4 * F.year(end) + F.quarter(end) - 4 * F.year(start) - F.quarter(start)
    elif unit == "week":
        out = F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7
    elif unit == "day":
        out = F.datediff(end, start)
    elif unit in ("hour", "minute", "second"):
        size = {"hour": 3600, "minute": 60, "second": 1}[unit]
        out = seconds_between(F.date_trunc(unit, start), F.date_trunc(unit, end)) / size
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return out.cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def concat(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def half_up_int(x: Column) -> Column:
    """A number as integer, rounded to the nearest (Spark's cast cuts)."""
    return F.round(x).cast("int")


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)
