"""Sources and sinks by type, with their options: DataFrames from CSV, Parquet, JSON, JDBC, REST, views; and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.names import check_name
from tidemark.sources import rest


class SourceError(ValueError):
    """Options that a source can't work with; the message lists all faults."""


@dataclass(frozen=True)
class Spec:
    """Options of a type: which are required (any of a group), their defaults, and its reader and writer."""

    read: Callable[[SparkSession, dict], DataFrame] | None = None
    write: Callable[[DataFrame, dict], None] | None = None
    required: tuple[tuple[str, ...], ...] = ()
    defaults: dict[str, Any] = field(default_factory=dict)


SPECS: dict[str, Spec] = {}
SYNC_MODES = ("full_refresh", "incremental", "cdc")
DESTINATION_MODES = ("append", "overwrite", "append_dedup", "merge")


def register_type(name: str, spec: Spec) -> None:
    SPECS[name.lower()] = spec


def option_errors(kind: str, options: dict) -> list[str]:
    """All faults of a source's options, those of incremental loads included."""
    if kind.lower() not in SPECS:
        return [f"type {kind!r} is none of {', '.join(sorted(SPECS))}"]
    errors = [f"{kind} needs {' or '.join(names)}" for names in SPECS[kind.lower()].required if not any(options.get(n) for n in names)]
    mode = options.get("sync_mode", "full_refresh")
    if mode not in SYNC_MODES:
        errors.append(f"sync_mode {mode!r} is none of {', '.join(SYNC_MODES)}")
    if mode == "incremental" and not options.get("cursor_field"):
        errors.append("sync_mode incremental needs cursor_field")
    to = options.get("destination_sync_mode")
    if to is not None and to not in DESTINATION_MODES:
        errors.append(f"destination_sync_mode {to!r} is none of {', '.join(DESTINATION_MODES)}")
    if to in ("append_dedup", "merge") and not options.get("primary_key"):
        errors.append(f"destination_sync_mode {to} needs primary_key")
    return errors


def merged(kind: str, *layers: dict | None) -> dict:
    """Options of a type: its defaults, then each layer (profile, then inline) over the ones before."""
    out = dict(SPECS[kind.lower()].defaults) if kind.lower() in SPECS else {}
    for layer in layers:
        out |= layer or {}
    errors = option_errors(kind, out)
    if errors:
        raise SourceError("; ".join(errors))
    return out


def read(spark: SparkSession, kind: str, *layers: dict | None) -> DataFrame:
    """A source's rows, lazily; ``columns`` and ``filters`` reach the scan where the format can take them."""
    options = merged(kind, *layers)
    reader = SPECS[kind.lower()].read
    if reader is None:
        raise SourceError(f"{kind} can't be read")
    df = reader(spark, options)
    for column, op, value in options.get("filters", ()):
        df = df.filter(_condition(F.col(column), op, value))
    if options.get("columns"):
        df = df.select(*options["columns"])
    return df


def _condition(column: Column, op: str, value) -> Column:
    if op == "in":
        return column.isin(*value)
    table = {"==": column == value, "=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}
    if op not in table:
        raise SourceError(f"unknown filter {op!r}")
    return table[op]


def after_cursor(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows beyond a stored cursor, which is text: compared in the column's type, text columns as time, else number, else text."""
    if value is None:
        return df
    kind, at, mark = df.schema[column].dataType, F.col(column), F.lit(value)
    if not isinstance(kind, T.StringType):
        return df.filter(at > mark.cast(kind))
    typed = F.coalesce(F.try_to_timestamp(at) > F.try_to_timestamp(mark), at.try_cast("double") > mark.try_cast("double"), at > mark)
    return df.filter(typed)


def next_cursor(df: DataFrame, column: str, before: str | None) -> str | None:
    """The largest cursor of the rows as text; what was before if there is none.  It never goes back, as rows lie beyond it."""
    kind, at = df.schema[column].dataType, F.col(column)
    order = F.struct(F.try_to_timestamp(at), at.try_cast("double"), at) if isinstance(kind, T.StringType) else at
    found = df.filter(at.isNotNull()).agg(F.max_by(at.cast("string"), order)).first()[0]
    return before if found is None else found


def write(df: DataFrame, kind: str, *layers: dict | None) -> None:
    """Write rows to a sink; ``mode`` is replace (the default) or append."""
    options = merged(kind, *layers)
    writer = SPECS[kind.lower()].write
    if writer is None:
        raise SourceError(f"{kind} can't be written")
    if options.get("mode", "replace") not in ("replace", "append", "upsert"):
        raise SourceError(f"unknown mode {options['mode']!r}")
    writer(df, options)


def _save_mode(options: dict) -> str:
    mode = options.get("mode", "replace")
    if mode == "upsert":
        raise SourceError("files can't be upserted; load into a table instead")
    return {"replace": "overwrite", "append": "append"}[mode]


def _read_csv(spark: SparkSession, o: dict) -> DataFrame:
    reader = spark.read.options(header=o["has_header"], sep=o["delimiter"], encoding=o["encoding"])
    return (reader.schema(o["schema"]) if o.get("schema") else reader.option("inferSchema", o["infer_schema"])).csv(o["path"])


def _write_csv(df: DataFrame, o: dict) -> None:
    """A folder of part files; one file if ``single_file``, for results that one task can write."""
    out = df.coalesce(1) if o.get("single_file") else df
    out.write.mode(_save_mode(o)).options(header=o["has_header"], sep=o["delimiter"], encoding=o["encoding"]).csv(o["path"])


def _read_parquet(spark: SparkSession, o: dict) -> DataFrame:
    return spark.read.option("mergeSchema", o["merge_schema"]).parquet(*([o["path"]] if isinstance(o["path"], str) else o["path"]))


def _write_parquet(df: DataFrame, o: dict) -> None:
    df.write.mode(_save_mode(o)).option("compression", o["compression"]).partitionBy(*o.get("partition_cols", ())).parquet(o["path"])


def _read_json(spark: SparkSession, o: dict) -> DataFrame:
    df = spark.read.option("multiLine", o["multi_line"]).json(o["path"])
    return flatten(df, o["depth"]) if o.get("flatten") else df


def flatten(df: DataFrame, depth: int = 5) -> DataFrame:
    """Nested structs as columns with dotted names, down to a depth; arrays and maps stay."""
    for _ in range(depth):
        if not any(isinstance(f.dataType, T.StructType) for f in df.schema):
            return df
        out = []
        for f in df.schema:
            at = F.col(f"`{f.name}`")
            out += [at.getField(x.name).alias(f"{f.name}.{x.name}") for x in f.dataType] if isinstance(f.dataType, T.StructType) else [at]
        df = df.select(*out)
    return df


def jdbc_options(o: dict) -> dict[str, str]:
    """Spark's options for a database: a table or query, fetch size, and partition bounds for parallel reads."""
    url = o.get("url") or f"jdbc:postgresql://{o['host']}:{o['port']}/{o['database']}"
    out = {"url": url, "fetchsize": str(o["fetch_size"])}
    out |= {k: str(o[k]) for k in ("user", "password", "driver") if o.get(k)}
    if o.get("query"):
        out["dbtable" if o.get("partition_column") else "query"] = f"({o['query']}) q" if o.get("partition_column") else o["query"]
    else:
        out["dbtable"] = f"{check_name(o['schema'])}.{check_name(o['table'])}" if o.get("schema") else check_name(o["table"])
    if o.get("partition_column"):
        out |= {"partitionColumn": o["partition_column"], "lowerBound": str(o["lower_bound"]), "upperBound": str(o["upper_bound"]), "numPartitions": str(o["num_partitions"])}
    return out


def _write_jdbc(df: DataFrame, o: dict) -> None:
    if o.get("mode") == "upsert":
        raise SourceError("write to a staging table and merge there; Spark's JDBC writer has no upsert")
    df.write.format("jdbc").options(**jdbc_options(o), batchsize=str(o["batch_size"]), truncate=str(o["truncate"]).lower()).mode(_save_mode(o)).save()


_FILES = {"csv": _read_csv, "json": _read_json, "jsonl": _read_json, "parquet": _read_parquet}


def object_paths(spark: SparkSession, o: dict) -> list[str]:
    """Objects below a prefix, smallest names first: up to ``max_files`` and ``max_bytes`` where they are given (for development)."""
    base = o.get("uri") or f"{o.get('scheme', 's3a')}://{o['bucket']}/{o.get('key') or o.get('path_prefix', '')}"
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not o.get("max_files") and not o.get("max_bytes"):
        return [base]
    found = sorted((str(s.getPath()), s.getLen()) for s in (fs.listStatus(where) if fs.getFileStatus(where).isDirectory() else [fs.getFileStatus(where)]) if s.isFile())
    out, total = [], 0
    for path, size in found[: o.get("max_files") or None]:
        total += size
        if o.get("max_bytes") and total > o["max_bytes"]:
            break
        out.append(path)
    return out


def _read_objects(spark: SparkSession, o: dict) -> DataFrame:
    form = o["file_format"]
    if form not in _FILES:
        raise SourceError(f"file_format {form!r} is none of {', '.join(_FILES)}")
    spec = SPECS["json" if form == "jsonl" else form]
    return _FILES[form](spark, spec.defaults | o | {"path": object_paths(spark, o)} | ({"multi_line": False} if form == "jsonl" else {}))


def _write_objects(df: DataFrame, o: dict) -> None:
    form = o["file_format"]
    SPECS[form].write(df, SPECS[form].defaults | o | {"path": o.get("uri") or f"{o.get('scheme', 's3a')}://{o['bucket']}/{o.get('key', '')}"})


_CSV = {"has_header": True, "delimiter": ",", "encoding": "utf-8", "infer_schema": True}
_JDBC = {"port": 5432, "schema": "public", "fetch_size": 10_000, "batch_size": 10_000, "truncate": False, "num_partitions": 8}
register_type("csv", Spec(_read_csv, _write_csv, (("path",),), _CSV))
register_type("parquet", Spec(_read_parquet, _write_parquet, (("path",),), {"merge_schema": False, "compression": "zstd"}))
register_type("json", Spec(_read_json, lambda df, o: df.write.mode(_save_mode(o)).json(o["path"]), (("path",),), {"multi_line": False, "depth": 5}))
register_type("postgres", Spec(lambda s, o: s.read.format("jdbc").options(**jdbc_options(o)).load(), _write_jdbc, (("host", "url"), ("database", "url"), ("table", "query")), _JDBC))
register_type("s3", Spec(_read_objects, _write_objects, (("uri", "bucket"),), {"file_format": "parquet", "depth": 5}))
register_type("memory", Spec(lambda s, o: s.table(o["name"]), lambda df, o: df.createOrReplaceTempView(o["name"]), (("name",),)))
register_type("rest", Spec(rest.read, None, (("url",), ("schema",)), rest.DEFAULTS))
register_type("shopify", Spec(rest.read_shop, None, (("shop",), ("access_token",), ("endpoint",), ("schema",)), rest.SHOP_DEFAULTS))
register_type("google_sheets", Spec(rest.read_sheet, None, (("spreadsheet_id",), ("access_token",), ("schema",)), rest.SHEET_DEFAULTS))
