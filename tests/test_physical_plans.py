"""What plans must look like at scale: pruned scans, pushed filters, partial aggregates, few exchanges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import load, partitions, quality, transform
from tidemark.queries import QUERIES
from tidemark.sources.tables import table

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prune_reaches_the_scan(spark):
    out = plan(partitions.prune(table(spark, DATA, "events").select("event_id", "ts"), "ts", partitions.TimeRange(datetime(2024, 1, 5), datetime(2024, 1, 8))))
    assert "GreaterThanOrEqual(ts" in out and "LessThan(ts" in out and "props" not in out and "Exchange" not in out


def test_orders_are_summed_before_they_are_joined(spark):
    out = plan(QUERIES["pipeline_customer_summary"](spark, DATA))
    assert "o_orderdate" not in out and "partial_sum" in out and "partial_count" in out


def test_quality_rules_are_one_pass(spark):
    rules = quality.null_rate("c_acctbal"), quality.negative_rate("c_acctbal")
    assert plan(quality.Validator(*rules).results(table(spark, DATA, "customer"))).count("FileScan") == 1


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk"](spark, DATA))


def test_high_water_moves_one_row_a_task(spark):
    out = plan(transform.high_water(table(spark, DATA, "events"), "ts"))
    assert "partial_max" in out and "event_id" not in out


def test_null_keys_are_dealt_over_all_tasks(spark):
    """An upsert where nearly all keys are null still has rows in every task of the join."""
    target = spark.range(4000).select(F.when(F.col("id") < 10, F.col("id")).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(p) for p in load.upsert(target, target.limit(10), ["k"], order_by="v").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 0.5 * sum(sizes)
