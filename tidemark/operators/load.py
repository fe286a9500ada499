"""Write modes of a load: what a target becomes when a source arrives.

All functions return the new content as a DataFrame; tables.VersionedTable
makes it the current one.  Keys are compared with ``=``, so a null key matches
nothing and its row is inserted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoadError(ValueError):
    """A load that can't be done; the message lists every reason."""


_FAMILIES = {
    "string": (T.StringType, T.VarcharType, T.CharType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
    "binary": (T.BinaryType,),
}


def type_family(kind: T.DataType) -> str:
    """The family within which load types may differ; nested types are families of their own."""
    return next((name for name, kinds in _FAMILIES.items() if isinstance(kind, kinds)), kind.simpleString())


def schema_errors(source: T.StructType, target: T.StructType) -> list[str]:
    """Why a source can't be loaded into a target: unknown columns and other type families."""
    known = {f.name.lower(): f for f in target}
    errors = []
    for f in source:
        at = known.get(f.name.lower())
        if at is None:
            errors.append(f"column {f.name!r} is not in the target")
        elif type_family(f.dataType) != type_family(at.dataType):
            errors.append(f"column {f.name!r} is {f.dataType.simpleString()}, the target's is {at.dataType.simpleString()}")
    return errors


def key_errors(keys: Sequence[str], source: T.StructType, target: T.StructType) -> list[str]:
    """Keys that are missing in either schema, or of different families."""
    errors = [] if keys else ["no key is given"]
    sides = {"source": {f.name.lower(): f for f in source}, "target": {f.name.lower(): f for f in target}}
    for key in keys:
        missing = [side for side, fields in sides.items() if key.lower() not in fields]
        errors += [f"key {key!r} is not in the {side}" for side in missing]
        if not missing and type_family(sides["source"][key.lower()].dataType) != type_family(sides["target"][key.lower()].dataType):
            errors.append(f"key {key!r} has different types in source and target")
    return errors


def conform(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source with the target's columns, names, order and types; columns it lacks are null."""
    errors = schema_errors(source.schema, target.schema)
    if errors:
        raise LoadError("; ".join(errors))
    have = {c.lower(): c for c in source.columns}
    return source.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])


def replace(target: DataFrame | None, source: DataFrame) -> DataFrame:
    return source


def append(target: DataFrame | None, source: DataFrame) -> DataFrame:
    """Rows of both; the source is matched by column name and cast to the target's types."""
    return source if target is None else target.unionByName(conform(source, target))


def latest(source: DataFrame, keys: Sequence[str], order_by: str, then: Column | None = None) -> DataFrame:
    """The last row of each key by ``order_by`` (nulls first); rows with a null key all stay.

    Of rows that tie, the largest by ``then`` wins, then the largest by a hash of
    all columns, so that the order of rows never matters.
    """
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    columns = [F.col(c) for c in source.columns]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in source.dtypes if "map<" not in kind])
    order = F.struct(F.col(order_by).isNotNull().alias("known"), F.col(order_by).alias("at"), (F.lit(0) if then is None else then).alias("then"), hashed.alias("hash"))
    last = source.filter(keyed).groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_row.*")
    return last.unionByName(source.filter(~keyed))


def _single(source: DataFrame, keys: Sequence[str], order_by: str | None) -> DataFrame:
    if order_by:
        return latest(source, keys, order_by)
    twice = source.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1").limit(1)
    if not twice.isEmpty():
        raise LoadError(f"keys {', '.join(keys)} occur more than once in the source; give order_by to take the last")
    return source


def upsert(target: DataFrame | None, source: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Update rows whose key matches, insert the others.

    A source with fewer columns leaves the others as they are (null in inserted
    rows).  A key that occurs twice in the source is an error unless
    ``order_by`` names the column whose largest value wins.
    """
    if target is None:
        return _single(source, keys, order_by)
    errors = key_errors(keys, source.schema, target.schema) + schema_errors(source.schema, target.schema)
    if errors:
        raise LoadError("; ".join(errors))
    one = _single(source, keys, order_by)
    have = {c.lower() for c in source.columns}
    named = [_named(target, k) for k in keys]
    fresh = conform(one, target)
    fresh = fresh.select(F.lit(True).alias("_fresh"), _spread(fresh, named).alias("_s_spread"), *[F.col(f"`{c}`").alias(f"_s_{c}") for c in target.columns])
    on = [F.col(f"`{k}`") == F.col(f"`_s_{k}`") for k in named] + [F.col("_spread") == F.col("_s_spread")]
    joined = target.withColumn("_spread", _spread(target, named)).join(fresh, on, "full_outer")
    pick = lambda c: F.when(F.col("_fresh"), F.col(f"`_s_{c}`")).otherwise(F.col(f"`{c}`")) if c.lower() in have else F.col(f"`{c}`")
    return joined.select(*[pick(c).alias(c) for c in target.columns])


def _named(df: DataFrame, column: str) -> str:
    return next(c for c in df.columns if c.lower() == column.lower())


def delete_insert(target: DataFrame | None, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without the target's rows whose key is in the source, and with all rows of the source, repeated keys too."""
    if target is None:
        return source
    errors = key_errors(keys, source.schema, target.schema)
    if errors:
        raise LoadError("; ".join(errors))
    fresh = conform(source, target)
    return without_keys(target, fresh, [_named(target, k) for k in keys]).unionByName(fresh)


def without_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target's rows whose key is not in the source; those with a null key stay, dealt evenly."""
    known = source.select(*[F.col(f"`{k}`").alias(f"_s_{k}") for k in keys]).dropna().distinct().withColumn("_s_spread", F.lit(0).cast("long"))
    on = [F.col(f"`{k}`") == F.col(f"`_s_{k}`") for k in keys] + [F.col("_spread") == F.col("_s_spread")]
    return target.withColumn("_spread", _spread(target, keys)).join(known, on, "left_anti").drop("_spread")


def with_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target's rows whose key is in the source."""
    have = {c.lower(): c for c in source.columns}
    named = [_named(target, k) for k in keys]
    known = source.select(*[F.col(f"`{have[k.lower()]}`").cast(target.schema[k].dataType).alias(f"_s_{k}") for k in named]).dropna().distinct()
    return target.join(known, [F.col(f"`{k}`") == F.col(f"`_s_{k}`") for k in named], "left_semi")


def _spread(df: DataFrame, keys: Sequence[str]) -> Column:
    """0, or a hash of the row where a key is null: rows that match nothing would else all meet in one task."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(f"`{k}`").isNull()
    return F.when(missing, F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])).otherwise(F.lit(0).cast("long"))


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys of the source an upsert inserts and how many it updates."""
    known = target.select(*keys, F.lit(True).alias("_known")).distinct()
    joined = source.join(known, list(keys), "left")
    return joined.agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if(F.col("_known").isNotNull()).alias("updated"))
