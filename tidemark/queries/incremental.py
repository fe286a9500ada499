"""Write modes, incremental transforms, strategies, cursors and streams, each over fixed parts of the tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import load, strategies, transform
from tidemark.operators.tables import VersionedTable
from tidemark.plans import pipeline as p
from tidemark.queries.registry import register
from tidemark.sources.shared import new_path
from tidemark.sources.tables import table, views
from tidemark.streaming import incremental as streams

# The target has two thirds of the orders; the source has every seventh, with another price.
_TARGET = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
_SOURCE = "SELECT o_orderkey, o_custkey, o_totalprice + 1000 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0"
_UPSERTED = f"WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "orders")
    return spark.sql(_TARGET), spark.sql(_SOURCE)


@register(_SOURCE)
def load_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.replace(*_sides(spark, sf_dir))


@register(f"{_TARGET} UNION ALL {_SOURCE}")
def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.append(*_sides(spark, sf_dir))


@register(_UPSERTED)
def load_upsert_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.upsert(*_sides(spark, sf_dir), ["o_orderkey"])


@register(_UPSERTED)
def load_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.delete_insert(*_sides(spark, sf_dir), ["o_orderkey"])


_BY_MONTH = "SELECT o_custkey, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders WHERE {where} GROUP BY 1, 2"


@register(
    f"""WITH t AS ({_BY_MONTH.format(where="o_orderkey % 2 = 0")}), s AS ({_BY_MONTH.format(where="o_orderkey % 5 = 0")})
        SELECT * FROM s UNION ALL SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = t.o_custkey AND s.month = t.month)"""
)
def load_upsert_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return load.upsert(spark.sql(_BY_MONTH.format(where="o_orderkey % 2 = 0")), spark.sql(_BY_MONTH.format(where="o_orderkey % 5 = 0")), ["o_custkey", "month"])


@register(
    f"""WITH t AS ({_TARGET}), s AS ({_SOURCE})
        SELECT t.o_orderkey, t.o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM t LEFT JOIN s USING (o_orderkey)
        UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)"""
)
def load_upsert_subset_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    return load.upsert(target, source.drop("o_custkey"), ["o_orderkey"])


@register(
    f"""WITH t AS ({_TARGET}), s AS (SELECT o_custkey AS o_orderkey, max(o_orderkey) AS o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1)
        SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)"""
)
def load_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source has many rows for a key; the one with the largest order column counts."""
    target, _ = _sides(spark, sf_dir)
    source = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("o_orderkey"), F.col("o_orderkey").alias("o_custkey"), "o_totalprice")
    return load.upsert(target, source, ["o_orderkey"], order_by="o_custkey")


@register(f"WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT count(*) FILTER (WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)) AS inserted, count(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM t)) AS updated FROM s")
def load_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.upsert_counts(*_sides(spark, sf_dir), ["o_orderkey"])


# Transform modes: the table holds events before the 10th, the second run is on the 20th.
_FIRST, _NOW = datetime(2024, 1, 10), datetime(2024, 1, 20)
_EVENTS = "SELECT event_id, ts, user_id, value FROM events"


@register(f"{_EVENTS} WHERE ts < TIMESTAMP '2024-01-10 00:00:00' UNION ALL {_EVENTS} WHERE event_type = 'error'")
def transform_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    target = spark.sql(f"{_EVENTS} WHERE ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return transform.apply(target, spark.sql(f"{_EVENTS} WHERE event_type = 'error'"), transform.Mode("APPEND"))


@register(
    """WITH t AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1), s AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
       SELECT * FROM s UNION ALL SELECT * FROM t WHERE user_id NOT IN (SELECT user_id FROM s)"""
)
def transform_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    per_user = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
    return transform.apply(per_user(events.filter(F.col("ts") < F.lit(_FIRST))), per_user(events.filter("event_type = 'click'")), transform.Mode("UPSERT", keys=("user_id",)))


_RANGE = "SELECT event_id, ts, user_id, value * 2 AS value FROM events WHERE ts >= @start_dt AND ts < @end_dt"


def _incremental(spark: SparkSession, sf_dir: str, lookback: str | None) -> DataFrame:
    views(spark, sf_dir, "events")
    target = spark.sql(_EVENTS).filter(F.col("ts") < F.lit(_FIRST).cast("timestamp_ntz"))
    start, end = transform.window(_FIRST, _NOW, lookback)
    fresh = transform.run_with_range(spark, _RANGE, start, end)
    return transform.apply(target, fresh, transform.Mode("INCREMENTAL", by="ts", lookback=lookback), start, end)


@register(f"{_EVENTS} WHERE ts < TIMESTAMP '2024-01-10 00:00:00' UNION ALL SELECT event_id, ts, user_id, value * 2 FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def transform_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incremental(spark, sf_dir, None)


@register(f"{_EVENTS} WHERE ts < TIMESTAMP '2024-01-08 00:00:00' UNION ALL SELECT event_id, ts, user_id, value * 2 FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def incremental_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incremental(spark, sf_dir, "2 DAYS")


# Strategies
@register(f"{_EVENTS} WHERE ts < TIMESTAMP '2024-01-10 00:00:00' UNION ALL {_EVENTS} WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00')")
def strategy_append_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    target = spark.sql(_EVENTS).filter(F.col("ts") < F.lit(_FIRST).cast("timestamp_ntz"))
    mark = transform.high_water(target, "ts").first()[0]
    return strategies.append_since(target, spark.sql(_EVENTS), "ts", F.lit(mark).cast("timestamp_ntz"))


@register(_SOURCE)
def strategy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    kept = VersionedTable(spark, new_path(spark, "snapshot"))
    kept.replace(target)
    return kept.replace(source)


@register(_TARGET)
def snapshot_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    kept = VersionedTable(spark, new_path(spark, "rollback"))
    kept.replace(target)
    kept.replace(source)
    return kept.rollback()


_CHANGES = """SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 4 = 1 THEN 5 ELSE 0 END AS o_totalprice,
              CASE o_orderkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'U' ELSE 'I' END AS op, 1 AS ts FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0
              UNION ALL SELECT o_orderkey, o_custkey, 0.0, 'D', 2 FROM orders WHERE o_orderkey % 15 = 0"""


@register(
    f"""WITH t AS ({_TARGET}), c AS ({_CHANGES}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts DESC) AS rn FROM c) WHERE rn = 1)
        SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM last WHERE op <> 'D'"""
)
def strategy_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _ = _sides(spark, sf_dir)
    return strategies.apply_changes(target, spark.sql(_CHANGES.replace("0.0", "0.0D")), ["o_orderkey"])


_TIMED_TARGET = "SELECT o_orderkey, o_totalprice, o_orderdate AS at FROM orders WHERE o_orderkey % 3 <> 0"
_TIMED_SOURCE = "SELECT o_orderkey, o_totalprice + 7 AS o_totalprice, o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '-1' DAY END AS at FROM orders WHERE o_orderkey % 7 = 0"


def _conflict(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return strategies.upsert_with(spark.sql(_TIMED_TARGET), spark.sql(_TIMED_SOURCE), ["o_orderkey"], rule, "at")


_BOTH = f"WITH t AS ({_TIMED_TARGET}), s AS ({_TIMED_SOURCE}) SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t) UNION ALL "


@register(_BOTH + "SELECT s.o_orderkey, CASE WHEN s.at >= t.at THEN s.o_totalprice ELSE t.o_totalprice END, greatest(s.at, t.at) FROM s JOIN t USING (o_orderkey)")
def conflict_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflict(spark, sf_dir, "latest_wins")


@register(_BOTH + "SELECT s.* FROM s WHERE o_orderkey IN (SELECT o_orderkey FROM t)")
def conflict_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflict(spark, sf_dir, "source_wins")


@register(_BOTH + "SELECT t.* FROM t WHERE o_orderkey IN (SELECT o_orderkey FROM s)")
def conflict_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflict(spark, sf_dir, "target_wins")


@register("SELECT * FROM (VALUES ('logs', 'append'), ('dimension', 'upsert'), ('small', 'snapshot'), ('feed', 'cdc'), ('unknown', 'append')) v(name, strategy)")
def auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = {
        "logs": strategies.LoadPattern(insert_rate=0.95, rows=10_000_000),
        "dimension": strategies.LoadPattern(insert_rate=0.2, update_rate=0.6, has_primary_key=True, rows=500_000),
        "small": strategies.LoadPattern(change_rate=0.9, rows=1000, bytes=1000),
        "feed": strategies.LoadPattern(insert_rate=0.3, update_rate=0.3, delete_rate=0.2, has_primary_key=True, has_change_flag=True, needs_history=True, rows=2_000_000),
        "unknown": strategies.LoadPattern(rows=5_000_000),
    }
    return spark.createDataFrame([(name, strategies.choose(x)) for name, x in patterns.items()], "name string, strategy string")


# Pipelines end to end
@register("SELECT event_id, ts, user_id, value FROM events")
def incremental_source_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a source that grows: the second reads what lies beyond the cursor that was committed with the first."""
    views(spark, sf_dir, "events")
    store, folder = new_path(spark, "store"), new_path(spark, "feed")
    steps = [p.Source("feed", "parquet", {"path": folder, "sync_mode": "incremental", "cursor_field": "ts"}), p.Load("seen", "feed", "APPEND")]
    rows = spark.sql(_EVENTS)
    early = F.col("ts") < F.lit(_FIRST).cast("timestamp_ntz")
    for part in (early, ~early):
        rows.filter(part).write.mode("append").parquet(folder)
        made = p.Pipeline(spark, store).run(steps).tables["seen"]
    return made


@register("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY 1")
def pipeline_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables, a default, a branch by condition and an export that is read back."""
    out = new_path(spark, "export")
    steps = [
        p.Set("least", 1000),
        p.Source("customers", "parquet", {"path": f"{sf_dir}/customer.parquet"}),
        p.Load("customers", "customers"),
        p.Branch(
            (
                ("${env|dev} == 'prod' AND ${least} > 0", (p.Table("segments", "SELECT c_mktsegment AS segment, count(*) AS n FROM customers WHERE c_acctbal > ${least} GROUP BY 1"),)),
                ("else", (p.Table("segments", "SELECT 'none' AS segment, 0L AS n"),)),
            )
        ),
        p.Export("segments", "csv", {"path": out}),
    ]
    p.Pipeline(spark, cli={"env": "prod"}).run(steps)
    return spark.read.csv(out, header=True, schema="segment string, n long")


@register(_UPSERTED)
def pipeline_upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads into a stored table; running the upsert twice changes nothing more."""
    target, source = _sides(spark, sf_dir)
    first, second = new_path(spark, "first"), new_path(spark, "second")
    target.write.parquet(first)
    source.write.parquet(second)
    load_first = [p.Source("a", "parquet", {"path": first}), p.Load("kept", "a")]
    then = [p.Source("b", "parquet", {"path": second}), p.Load("kept", "b", "UPSERT", ("o_orderkey",))]
    run = p.Pipeline(spark, new_path(spark, "store"))
    run.run(load_first)
    run.run(then)
    return run.run(then).tables["kept"]


@register(_UPSERTED)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files upserted in micro-batches, with the checkpoint remembering what was read."""
    target, source = _sides(spark, sf_dir)
    folder, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    kept = VersionedTable(spark, new_path(spark, "stream-table"))
    for part in (target, source):
        part.write.mode("append").parquet(folder)
        out = streams.upsert_new_files(spark, folder, target.schema, kept, ["o_orderkey"], checkpoint)
    return out


@register(
    """SELECT to_timestamp(0)::TIMESTAMP + INTERVAL 1 SECOND * (floor(epoch(ts) / 3600) * 3600) AS "start", to_timestamp(0)::TIMESTAMP + INTERVAL 1 SECOND * (floor(epoch(ts) / 3600) * 3600 + 3600) AS "end", event_type, count(*) AS n
       FROM events GROUP BY 1, 2, 3"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events as a stream with a watermark, drained to its end."""
    folder = new_path(spark, "events")
    table(spark, sf_dir, "events").select("ts", "event_type").write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(folder)
    counts = streams.windowed_counts(stream, "ts", ["event_type"], "1 hour")
    out = streams.to_table(spark, counts, f"windows_{uuid.uuid4().hex}", new_path(spark, "windows"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@register(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    return streams.sessions(events, "ts", ["user_id"])
