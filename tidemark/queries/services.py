"""Schema evolution, partitions, data quality, profiles, functions, masking and file formats."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import masking, udfs
from tidemark.operators import evolution, partitions, profile, quality
from tidemark.queries.registry import register
from tidemark.sources import registry as sources
from tidemark.sources.shared import new_path
from tidemark.sources.tables import table, views

_HOLED = "SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("balance"))


def _value(df: DataFrame, rule: quality.Rule) -> DataFrame:
    return quality.Validator(rule).results(df).select("rule", F.round("value", 6).alias("value"), "passed")


@register(f"SELECT 'null_check_balance' AS rule, round(avg(CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END), 6) AS value, avg(CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END) <= 0.1 AS passed FROM ({_HOLED})")
def dq_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(_holed(spark, sf_dir), quality.null_rate("balance"))


@register("SELECT 'duplicate_check_text' AS rule, round(1 - count(DISTINCT text) / count(*), 6) AS value, 1 - count(DISTINCT text) / count(*) <= 0 AS passed FROM documents")
def dq_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(table(spark, sf_dir, "documents").select("text"), quality.duplicate_rate("text"))


@register(f"SELECT 'negative_values_balance' AS rule, round(count(*) FILTER (WHERE balance < 0) / count(*), 6) AS value, count(*) FILTER (WHERE balance < 0) = 0 AS passed FROM ({_HOLED})")
def dq_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(_holed(spark, sf_dir), quality.negative_rate("balance"))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def dq_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return quality.orphans(orders, "o_custkey", table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0"), "c_custkey")


_NOW = datetime(2024, 3, 1)


@register("SELECT 'data_freshness_ts' AS rule, round(epoch(TIMESTAMP '2024-03-01 00:00:00' - max(ts)) / 3600, 3) AS value, epoch(TIMESTAMP '2024-03-01 00:00:00' - max(ts)) / 3600 <= 24 AS passed FROM events")
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.Validator(quality.freshness_hours("ts", _NOW)).results(table(spark, sf_dir, "events"))
    return found.select("rule", F.round("value", 3).alias("value"), "passed")


@register(
    f"""WITH d AS ({_HOLED}), r AS (
        SELECT 0.5 AS w, count(*) FILTER (WHERE balance IS NULL) / count(*) <= 0.1 AS ok FROM d UNION ALL SELECT 0.5, count(*) FILTER (WHERE balance < 0) = 0 FROM d UNION ALL SELECT 1.0, count(DISTINCT c_custkey) = count(*) FROM d)
        SELECT CAST(sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w) AS DOUBLE) AS score, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM r"""
)
def dq_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.null_rate("balance"), quality.negative_rate("balance"), quality.duplicate_rate("c_custkey")
    return quality.Validator(*rules).score(_holed(spark, sf_dir))


@register("SELECT date_trunc('day', ts) AS period, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def partition_virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.virtual(table(spark, sf_dir, "events"), "ts")


@register("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-08 00:00:00'")
def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = partitions.TimeRange(datetime(2024, 1, 5), datetime(2024, 1, 8))
    return partitions.prune(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", span)


@register("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT date_trunc('month', ts)) AS months, date_diff('day', min(ts), max(ts)) + 1 AS span_days FROM events")
def partition_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.statistics(table(spark, sf_dir, "events"), "ts")


_SPANS = " UNION ALL ".join(
    f"SELECT '{name}' AS name, CAST({at} AS DATE) AS day FROM {name} WHERE {where}"
    for name, at, where in (("orders", "o_orderdate", "o_orderkey % 2 = 0"), ("lineitem", "l_shipdate", "l_shipdate < DATE '1995-06-01'"), ("events", "ts", "true"))
)


@register(
    f"""WITH d AS ({_SPANS}), s AS (SELECT name, count(*) AS n, CAST(max(day) - min(day) AS BIGINT) AS span, count(DISTINCT day) AS days, count(DISTINCT date_trunc('month', day)) AS months FROM d GROUP BY name),
        g AS (SELECT *, CASE WHEN n < 1000 THEN NULL WHEN span <= 30 OR span <= 365 AND days <= 52 THEN 'day' WHEN span <= 365 THEN 'week' ELSE 'month' END AS granularity FROM s),
        p AS (SELECT *, CASE granularity WHEN 'day' THEN days WHEN 'week' THEN span // 7 WHEN 'month' THEN months END AS parts FROM g)
        SELECT name, granularity, CAST(parts AS BIGINT) AS parts, parts > 100 AS virtual FROM p"""
)
def partition_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions from the statistics of three time columns of different spans."""
    views(spark, sf_dir, "orders", "lineitem", "events")
    days = spark.sql(_SPANS)
    out = []
    for name in ("orders", "lineitem", "events"):
        s = partitions.statistics(days.filter(F.col("name") == name), "day").first()
        found = partitions.suggest(s["rows"] - s["nulls"], s["first"], s["last"], s["days"], s["months"], least_rows=1000)
        out.append((name, *((found.granularity, found.parts, found.virtual) if found else (None, None, None))))
    return spark.createDataFrame(out, "name string, granularity string, parts long, virtual boolean")


@register("SELECT * FROM (VALUES ('added', 'note'), ('narrowed', 'n_name_id'), ('removed', 'n_regionkey'), ('widened', 'n_nationkey')) v(change, column_name)")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").withColumn("n_name_id", F.lit(1).cast("bigint")).schema
    new = T.StructType([T.StructField("N_NATIONKEY", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_name_id", T.IntegerType()), T.StructField("note", T.StringType())])
    found = evolution.diff(old, new)
    rows = [(kind, c.lower()) for kind in ("added", "removed", "widened", "narrowed", "incompatible") for c in getattr(found, kind)]
    return spark.createDataFrame(rows, "change string, column_name string")


@register("SELECT n_nationkey, n_name, n_regionkey, 'none' AS note FROM nation")
def schema_evolve_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return evolution.evolve(nation, T.StructType([*nation.schema, T.StructField("note", T.StringType())]), {"note": F.lit("none")})


@register("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def schema_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.evolve(table(spark, sf_dir, "part").select("p_partkey", "p_size"), T.StructType.fromDDL("p_partkey bigint, p_size bigint"))


@register(
    """SELECT 'c_custkey' AS column_name, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, count(DISTINCT c_custkey) AS distinct_values, CAST(min(c_custkey) AS VARCHAR) AS low, CAST(max(c_custkey) AS VARCHAR) AS high FROM customer
       UNION ALL SELECT 'c_mktsegment', count(*), CAST(0 AS BIGINT), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer
       UNION ALL SELECT 'c_nationkey', count(*), CAST(0 AS BIGINT), count(DISTINCT c_nationkey), CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer"""
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey"])


# Python functions
@udfs.scalar_udf(returns="double", vectorised=True)
def with_tax(price: pd.Series, rate: pd.Series) -> pd.Series:
    return price * (1 + rate)


@udfs.scalar_udf
def shout(text: str, mark: str = "!") -> str:
    return None if text is None else text.upper() + mark


@udfs.table_udf(schema="o_orderkey long, band string", required=("o_orderkey", "o_totalprice"), row_local=True)
def price_band(pdf: pd.DataFrame, limit: float = 100_000.0) -> pd.DataFrame:
    return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "band": (pdf["o_totalprice"] > limit).map({True: "high", False: "low"})})


@udfs.table_udf(schema="o_custkey long, orders long, spread double", required=("o_custkey", "o_totalprice"), many=True)
def spread(pdf: pd.DataFrame) -> pd.DataFrame:
    prices = pdf.groupby("o_custkey")["o_totalprice"]
    return pd.DataFrame({"orders": prices.size(), "spread": prices.max() - prices.min()}).reset_index()


@udfs.table_udf(schema="c_nationkey int, customers long, richest string", required=("c_nationkey", "c_name", "c_acctbal"))
def richest(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"c_nationkey": [pdf["c_nationkey"].iloc[0]], "customers": [len(pdf)], "richest": [pdf.sort_values(["c_acctbal", "c_name"])["c_name"].iloc[-1]]})


@register("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 + l_tax) AS taxed FROM lineitem")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_tax.register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, with_tax(l_extendedprice, l_tax) AS taxed FROM lineitem")


@register("SELECT n_nationkey, upper(n_name) || '!' AS loud, upper(n_name) || '?' AS asked FROM nation")
def udf_default_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    shout.register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, shout(n_name) AS loud, shout(n_name, '?') AS asked FROM nation")


@register("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS band FROM orders")
def udf_table_rowlocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_band(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), limit=150_000.0)


@register("SELECT o_custkey, count(*) AS orders, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey")
def udf_table_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), by=["o_custkey"])


@register("SELECT c_nationkey, count(*) AS customers, arg_max(c_name, (c_acctbal, c_name)) AS richest FROM customer GROUP BY c_nationkey")
def udf_table_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return richest(table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_acctbal"), by=["c_nationkey"])


def _masked_sql(text: str) -> str:
    for kind, pattern in masking.PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '[{kind.upper()}]', 'g')"
    return text


@register(f"SELECT doc_id, sha256({_masked_sql('text')}) AS masked FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(masking.mask(F.col("text")), 256).alias("masked"))


@register("SELECT conv_id, turn, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT) AS {kind}" for kind, pattern in masking.PATTERNS.items()) + " FROM conversations")
def pii_detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in masking.counts(F.col("text")).items()])


# File formats
@register("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey IN (1, 2, 3)")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    sources.write(table(spark, sf_dir, "customer"), "csv", {"path": path, "delimiter": "|"})
    options = {"path": path, "delimiter": "|", "schema": table(spark, sf_dir, "customer").schema, "columns": ["c_custkey", "c_name", "c_nationkey"], "filters": [("c_nationkey", "in", [1, 2, 3])]}
    return sources.read(spark, "csv", options)


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def parquet_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by status; reading one status lists one folder."""
    path = new_path(spark, "parquet")
    sources.write(table(spark, sf_dir, "orders").repartition("o_orderstatus"), "parquet", {"path": path, "partition_cols": ["o_orderstatus"]})
    return sources.read(spark, "parquet", {"path": path, "filters": [("o_orderstatus", "==", "F")], "columns": ["o_orderstatus", "o_orderkey", "o_totalprice"]}).drop("o_orderstatus")


@register('SELECT n_nationkey, n_name AS "nation.name", n_regionkey AS "nation.region.key" FROM nation')
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    nested = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").cast("long").alias("key")).alias("region")).alias("nation"))
    sources.write(nested, "json", {"path": path})
    flat = sources.read(spark, "json", {"path": path, "flatten": True})
    return flat.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "`nation.name`", F.col("`nation.region.key`").cast("int").alias("nation.region.key"))


@register("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def csv_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text cursor compared as time."""
    path = new_path(spark, "csv")
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    sources.write(rows, "csv", {"path": path})
    read = sources.read(spark, "csv", {"path": path, "schema": "event_id long, ts string"})
    return sources.after_cursor(read, "ts", "2024-01-20 00:00:00").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
