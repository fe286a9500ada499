"""Transform modes: replace, append, upsert, and incremental by a time column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import load

MODES = ("REPLACE", "APPEND", "UPSERT", "INCREMENTAL")
_UNITS = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(weeks=1), "month": timedelta(days=30), "year": timedelta(days=365)}


class ModeError(ValueError):
    """Options that don't go with a mode."""


@dataclass(frozen=True)
class Mode:
    """A transform mode with its options; validated when made."""

    name: str = "REPLACE"
    by: str | None = None
    keys: tuple[str, ...] = ()
    lookback: str | None = None

    def __post_init__(self):
        name = self.name.upper()
        object.__setattr__(self, "name", name)
        errors = []
        if name not in MODES:
            errors.append(f"mode {self.name!r} is none of {', '.join(MODES)}")
        if (name == "INCREMENTAL") != bool(self.by):
            errors.append("INCREMENTAL needs a time column, and no other mode takes one")
        if (name == "UPSERT") != bool(self.keys):
            errors.append("UPSERT needs keys, and no other mode takes them")
        if self.lookback and name != "INCREMENTAL":
            errors.append("LOOKBACK goes with INCREMENTAL only")
        if errors:
            raise ModeError("; ".join(errors))
        if self.lookback:
            parse_lookback(self.lookback)


def parse_lookback(text: str | None) -> timedelta:
    """'2 DAYS', '36 hours' ...; months are 30 days and years 365."""
    if not text:
        return timedelta(0)
    found = re.fullmatch(r"\s*'?(\d+)\s+([a-z]+?)s?'?\s*", text, re.I)
    if not found or found[2].lower() not in _UNITS:
        raise ModeError(f"lookback {text!r} is not a number and a unit")
    return int(found[1]) * _UNITS[found[2].lower()]


def window(watermark: datetime | None, now: datetime, lookback: str | None = None, first_days: int = 30) -> tuple[datetime, datetime]:
    """The half-open range [start, end) to compute: from the watermark less the lookback, or the last days at first."""
    start = watermark - parse_lookback(lookback) if watermark else now - timedelta(days=first_days)
    return start, now


_MACRO = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)|@\s?(start_date|end_date|start_dt|end_dt)\b", re.S)


def run_with_range(spark: SparkSession, query: str, start: datetime, end: datetime) -> DataFrame:
    """The query with @start_date, @end_date, @start_dt and @end_dt as bound values; quotes and comments are left alone."""
    text = _MACRO.sub(lambda m: m[1] or f":{m[2]}", query)
    values = {"start_date": start.date(), "end_date": end.date(), "start_dt": start, "end_dt": end}
    return spark.sql(text, args={k: v for k, v in values.items() if f":{k}" in text})


def in_range(kind: T.DataType, by: str, start: datetime, end: datetime) -> Column:
    """Whether a time is in [start, end); on a DATE column the range is whole days, both ends included."""
    if isinstance(kind, T.DateType):
        return F.col(by).between(F.lit(start.date()), F.lit(end.date()))
    return (F.col(by) >= F.lit(start).cast(kind)) & (F.col(by) < F.lit(end).cast(kind))


def incremental(target: DataFrame | None, fresh: DataFrame, by: str, start: datetime, end: datetime) -> DataFrame:
    """The target with the range of its time column replaced by the fresh rows of that range: see :func:`in_range`.

    Rows with a null time are kept in the target and not taken from the fresh rows.
    """
    inside = in_range(fresh.schema[by].dataType, by, start, end)
    fresh = fresh.filter(inside)
    if target is None:
        return fresh
    return target.filter(~F.coalesce(inside, F.lit(False))).unionByName(load.conform(fresh, target))


def high_water(df: DataFrame, by: str) -> DataFrame:
    """One row with the largest value of the time column; over Parquet the scan reads footers only."""
    return df.agg(F.max(by).alias("watermark"))


def apply(target: DataFrame | None, fresh: DataFrame, mode: Mode, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """What a table becomes when a transform's rows are written in a mode."""
    if mode.name == "REPLACE":
        return fresh
    if mode.name == "APPEND":
        return load.append(target, fresh)
    if mode.name == "UPSERT":
        return load.delete_insert(target, fresh, mode.keys)
    if start is None or end is None:
        raise ModeError("INCREMENTAL needs a range")
    return incremental(target, fresh, mode.by, start, end)


def keys_of(text: str | Sequence[str] | None) -> tuple[str, ...]:
    """Keys from 'a, b', a sequence, or nothing."""
    if not text:
        return ()
    return tuple(k.strip() for k in text.split(",")) if isinstance(text, str) else tuple(text)
