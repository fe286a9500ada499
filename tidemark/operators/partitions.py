"""Time partitions: ranges, names, detection, pruning, statistics and a suggestion."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "week", "month", "quarter", "year")
_FORMATS = {"hour": "%Y%m%d%H", "day": "%Y%m%d", "month": "%Y%m", "year": "%Y"}


@dataclass(frozen=True)
class TimeRange:
    """Half-open [start, end)."""

    start: datetime
    end: datetime

    def contains(self, at: datetime) -> bool:
        return self.start <= at < self.end

    def overlaps(self, other: TimeRange) -> bool:
        return self.start < other.end and other.start < self.end

    def name(self, granularity: str = "day") -> str:
        if granularity == "week":
            year, week, _ = self.start.isocalendar()
            return f"{year}w{week:02d}"
        if granularity == "quarter":
            return f"{self.start.year}q{(self.start.month + 2) // 3}"
        return self.start.strftime(_FORMATS[granularity])


def by_name(table: str, names: Iterable[str]) -> dict[str, TimeRange]:
    """Tables named <table>_p_ and a year, month or day, with their ranges; impossible dates are left out."""
    out = {}
    for name in names:
        found = re.fullmatch(rf"{re.escape(table)}_p_(\d{{4}})(\d{{2}})?(\d{{2}})?", name)
        if found and (span := _span(*found.groups())):
            out[name] = span
    return out


def by_path(paths: Iterable[str]) -> dict[str, TimeRange]:
    """Paths with year=/month=/day=, dt= or date=, or eight digits."""
    out = {}
    for path in paths:
        parts = dict(re.findall(r"(year|month|day)=(\d+)", path))
        day = re.search(r"(?:dt|date)=(\d{4})-?(\d{2})-?(\d{2})", path) or re.search(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", path)
        span = _span(parts["year"], parts.get("month"), parts.get("day")) if "year" in parts else _span(*day.groups()) if day else None
        if span:
            out[path] = span
    return out


def _span(year: str, month: str | None = None, day: str | None = None) -> TimeRange | None:
    try:
        start = datetime(int(year), int(month or 1), int(day or 1))
    except ValueError:
        return None
    if day:
        return TimeRange(start, start + timedelta(days=1))
    if month:
        return TimeRange(start, datetime(start.year + start.month // 12, start.month % 12 + 1, 1))
    return TimeRange(start, datetime(start.year + 1, 1, 1))


def virtual(df: DataFrame, column: str, granularity: str = "day") -> DataFrame:
    """Rows, and first and last time, of each period of a time column: period, rows, first, last.  Null times have no period."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity {granularity!r} is none of {', '.join(GRANULARITIES)}")
    rows = df.filter(F.col(column).isNotNull()).groupBy(F.date_trunc(granularity, column).alias("period"))
    return rows.agg(F.count("*").alias("rows"), F.min(column).alias("first"), F.max(column).alias("last"))


def prune(df: DataFrame, column: str, span: TimeRange) -> DataFrame:
    """Rows in a range; on a partition column the scan lists only those folders, else the filter is pushed to it."""
    return df.filter((F.col(column) >= F.lit(span.start).cast(df.schema[column].dataType)) & (F.col(column) < F.lit(span.end).cast(df.schema[column].dataType)))


def statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, nulls, first, last, days and months (distinct) and span_days of a time column."""
    at = F.col(column)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(at.isNull()).alias("nulls"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.countDistinct(F.to_date(at)).alias("days"),
        F.countDistinct(F.trunc(F.to_date(at), "month")).alias("months"),
        (F.datediff(F.max(at), F.min(at)) + 1).cast("bigint").alias("span_days"),
    )


@dataclass(frozen=True)
class Suggestion:
    """A granularity, how many partitions it makes, and whether so many should be virtual."""

    granularity: str
    parts: int
    virtual: bool


def suggest(rows: int, first: date | None, last: date | None, days: int, months: int, least_rows: int = 100_000) -> Suggestion | None:
    """How to partition a table by time, from its statistics; None if it has fewer than ``least_rows`` rows.

    Days up to a span of 30 days; up to a year weeks if more than 52 days have
    rows, else days; months beyond.
    """
    if rows < least_rows or first is None or last is None:
        return None
    span = (last - first).days
    if span <= 30 or (span <= 365 and days <= 52):
        kind, parts = "day", days
    elif span <= 365:
        kind, parts = "week", span // 7
    else:
        kind, parts = "month", months
    return Suggestion(kind, parts, parts > 100)
