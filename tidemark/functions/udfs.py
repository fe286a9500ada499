"""Python functions for SQL and DataFrames: scalar, vectorised, and table functions.

A scalar function runs with Arrow batches; one that takes and returns pandas
Series is a pandas UDF.  A table function maps a pandas DataFrame to another:
``row_local`` ones run batch by batch and need no shuffle, grouped ones run once
for each key, or with ``many`` once for many whole groups.  Groups are cut from
sorted batches, so that small groups share them.  A function of a whole table
that is neither would need the table in one task, so it isn't offered.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
import typing
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}


class UdfError(ValueError):
    """A function that doesn't keep its contract."""


@dataclass(frozen=True)
class ScalarUdf:
    name: str
    function: Callable
    returns: T.DataType | str
    vectorised: bool = False

    def __call__(self, *args):
        return self.function(*args)

    def register(self, spark: SparkSession) -> None:
        """Make it callable from SQL; arguments with defaults may be left out."""
        made = F.pandas_udf(self.function, self.returns) if self.vectorised else F.udf(self.function, self.returns, useArrow=True)
        spark.udf.register(self.name, made)


@dataclass(frozen=True)
class TableUdf:
    name: str
    function: Callable[[pd.DataFrame], pd.DataFrame]
    schema: T.StructType | str
    required: tuple[str, ...] = ()
    row_local: bool = False
    many: bool = False

    def __call__(self, df: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
        """Apply to a DataFrame: batch by batch if row-local, else once for each group of ``by``."""
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise UdfError(f"{self.name} needs columns {', '.join(missing)}")
        function, name = self.function, self.name
        schema = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema

        def checked(pdf: pd.DataFrame) -> pd.DataFrame:
            out = function(pdf, **options)
            lacking = [c for c in schema.names if c not in out.columns]
            if lacking:
                raise UdfError(f"{name} returned no columns {', '.join(lacking)}")
            out = out[schema.names]
            # strings that were joined from several batches are chunked, which Spark's conversion doesn't take
            return out.astype({c: object for c, kind in out.dtypes.items() if isinstance(kind, pd.StringDtype)})

        if by:
            return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(_groups(checked, list(by), self.many), schema)
        if not self.row_local:
            raise UdfError(f"{name} is not row-local, so it needs columns to group by")

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield checked(part)

        return df.mapInPandas(batches, schema)


def _starts(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Whether each row but the first begins a group; nulls are alike."""
    out = np.zeros(max(0, len(frame) - 1), bool)
    for name in by:
        missing = frame[name].isna().to_numpy()
        values = frame[name].to_numpy()
        differs = np.fromiter((a != b for a, b in zip(values[1:], values[:-1])), bool, len(out)) if values.dtype == object else values[1:] != values[:-1]
        out |= (missing[1:] != missing[:-1]) | (differs & ~missing[1:])
    return out


def _groups(function: Callable[[pd.DataFrame], pd.DataFrame], by: list[str], many: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Run a function over whole groups of sorted batches; the last group of a batch waits for the next one."""

    def whole(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if many:
            yield function(frame)
            return
        at = [0, *(np.flatnonzero(_starts(frame, by)) + 1), len(frame)]
        yield pd.concat([function(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(at, at[1:])], ignore_index=True)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for frame in filter(len, frames):
            if waiting and _starts(pd.concat([waiting[-1].tail(1), frame.head(1)], ignore_index=True), by)[0]:
                yield from whole(pd.concat(waiting, ignore_index=True))
                waiting = []
            starts = np.flatnonzero(_starts(frame, by)) + 1
            if len(starts):
                yield from whole(pd.concat([*waiting, frame.iloc[: starts[-1]]], ignore_index=True))
                waiting, frame = [], frame.iloc[starts[-1] :]
            waiting.append(frame)
        if waiting:
            yield from whole(pd.concat(waiting, ignore_index=True))

    return batches


def scalar_udf(function: Callable | None = None, *, name: str | None = None, returns: T.DataType | str | None = None, vectorised: bool = False):
    """Decorator; the return type comes from the annotation (double if there is none)."""

    def make(f: Callable) -> ScalarUdf:
        kind = returns
        if kind is None:
            hint = typing.get_type_hints(f).get("return")
            options = [a for a in typing.get_args(hint) if a is not type(None)]
            kind = _TYPES.get(options[0] if options else hint, T.DoubleType())
        return ScalarUdf(name or f.__name__, f, kind, vectorised)

    return make(function) if function else make


def table_udf(*, schema: str | T.StructType, name: str | None = None, required: tuple[str, ...] = (), row_local: bool = False, many: bool = False):
    """Decorator for a function whose first argument is a pandas DataFrame; further arguments need defaults.

    With ``many`` a grouped function gets several whole groups at once, sorted
    by their keys, and tells them apart itself.
    """

    def make(f: Callable) -> TableUdf:
        params = list(inspect.signature(f).parameters.values())
        if not params or any(p.default is p.empty for p in params[1:]):
            raise UdfError(f"{f.__name__} must take a DataFrame, and further arguments with defaults only")
        return TableUdf(name or f.__name__, f, schema, tuple(required), row_local, many)

    return make


def infer_schema(function: Callable[[pd.DataFrame], pd.DataFrame], sample: DataFrame, rows: int = 1000) -> T.StructType:
    """The schema of what a table function returns for the first rows of a sample."""
    spark = sample.sparkSession
    return spark.createDataFrame(function(sample.limit(rows).toPandas())).schema


def discover(package: str) -> dict[str, ScalarUdf | TableUdf]:
    """All decorated functions of a package, by module.name."""
    root = importlib.import_module(package)
    modules = [root, *(importlib.import_module(m.name) for m in pkgutil.iter_modules(getattr(root, "__path__", []), f"{package}."))]
    return {f"{m.__name__.removeprefix(package + '.')}.{x.name}": x for m in modules for x in vars(m).values() if isinstance(x, (ScalarUdf, TableUdf))}


def register_all(spark: SparkSession, found: dict[str, ScalarUdf | TableUdf]) -> None:
    """Register all scalar functions for SQL."""
    for f in found.values():
        if isinstance(f, ScalarUdf):
            f.register(spark)
