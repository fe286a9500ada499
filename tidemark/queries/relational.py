"""Relational queries: projection, filters, joins, aggregates, windows, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dialect
from tidemark.operators.asof import as_of
from tidemark.queries.registry import register, sql_query
from tidemark.sources.tables import table

_REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"

# Filters and expressions
sql_query(
    "projection_alias",
    "lineitem",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_quantity * l.l_extendedprice AS gross, l.l_extendedprice * (1 - l.l_discount) AS net FROM lineitem l WHERE l.l_quantity >= 45",
)
sql_query(
    "filter_between_in_like",
    "orders part",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND o_orderpriority LIKE '%-%'""",
)
sql_query("filter_boolean", "customer", "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND c_nationkey <> 3 AND NOT c_acctbal < 100")
sql_query(
    "null_predicates",
    "customer",
    """SELECT c_custkey, b IS NULL AS missing, coalesce(b, -1.0) AS balance FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer)
       WHERE b IS NULL OR (b IS NOT NULL AND c_custkey % 5 = 0)""",
)
sql_query(
    "case_segmentation",
    "customer",
    """SELECT CASE WHEN c_acctbal >= 7500 THEN 'premium' WHEN c_acctbal >= 2500 THEN 'standard' ELSE 'basic' END AS tier,
              CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS segment, count(*) AS n
       FROM customer GROUP BY 1, 2""",
)


# Joins
@register(
    """SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS n_customers, count(o.o_orderkey) AS n_orders,
       CAST(coalesce(sum(CAST(o.o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS total_price
       FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment"""
)
def pipeline_customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before the join, so the join moves a row for each customer."""
    price = F.col("o_totalprice").cast("decimal(14,2)")
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum(price).alias("price"))
    customers = table(spark, sf_dir, "customer")
    joined = customers.join(per_customer, customers.c_custkey == per_customer.o_custkey, "left")
    return joined.groupBy("c_mktsegment").agg(
        F.countDistinct("c_custkey").alias("n_customers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("total_price"),
    )


sql_query("join_inner", "orders customer", "SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'")
sql_query("join_left", "customer orders", "SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
sql_query("join_right", "supplier nation", "SELECT s.s_suppkey, n.n_nationkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
sql_query(
    "join_full",
    "customer supplier",
    """SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
       FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) c
       FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1) s ON c.k = s.k""",
)
sql_query(
    "join_cross_stats",
    "orders",
    """SELECT o.o_orderkey, o.o_totalprice > s.mean * 1.5 AS large FROM orders o CROSS JOIN (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) AS mean FROM orders) s""",
)
sql_query("join_semi", "customer orders", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql_query("join_semi_in", "part lineitem", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
sql_query("join_anti", "customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql_query("join_anti_left_null", "part lineitem", "SELECT p.p_partkey FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 30) l ON p.p_partkey = l.l_partkey WHERE l.l_partkey IS NULL")
sql_query(
    "join_star",
    "lineitem orders customer nation region",
    f"""SELECT r.r_name, year(o.o_orderdate) AS y, {_REVENUE} AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""",
    f"""SELECT r.r_name, CAST(year(o.o_orderdate) AS INTEGER) AS y, {_REVENUE} AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""",
)
sql_query("join_theta", "supplier nation", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")

sql_query("join_lateral", "nation customer", "SELECT n.n_name, t.n, t.richest FROM nation n, LATERAL (SELECT count(*) AS n, max(c.c_acctbal) AS richest FROM customer c WHERE c.c_nationkey = n.n_nationkey) t")
sql_query(
    "join_interval",
    "events",
    """SELECT a.event_id AS error, count(b.event_id) AS before FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 6 HOURS
       WHERE a.event_type = 'error' GROUP BY a.event_id""",
)


@register(
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
       SELECT e.event_id, c.ts AS click_ts, c.value FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts"""
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error with its user's last click at or before it."""
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return as_of(errors, clicks, ["user_id"], "ts").select("event_id", F.col("right.ts").alias("click_ts"), F.col("right.value").alias("value"))


# Aggregates
sql_query(
    "agg_basic",
    "lineitem",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty, {_REVENUE} AS revenue, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
               CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS mean_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql_query("agg_global", "orders", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
sql_query("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
sql_query(
    "agg_conditional",
    "orders",
    "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS closed, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders GROUP BY o_orderpriority",
)
sql_query("agg_filter", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY o_orderpriority")
sql_query("agg_stddev", "customer", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(variance(c_acctbal) / 1e6, 4) AS var FROM customer GROUP BY c_mktsegment")
sql_query(
    "agg_string",
    "nation",
    "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
sql_query(
    "agg_string_distinct",
    "customer",
    "SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), '|') AS segments FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey",
)
sql_query("agg_percentile", "orders", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM orders GROUP BY o_orderstatus")
sql_query("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("agg_by_month", "orders", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY date_trunc('month', o_orderdate)")
sql_query("agg_rollup", "customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
sql_query("agg_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("agg_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")

# Windows; all orders are total
sql_query("win_row_number", "orders", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) WHERE rn <= 2")
sql_query(
    "win_ranks",
    "part",
    """SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS next_key,
              first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS first_key FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
)
sql_query("win_ntile", "customer", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quartile FROM customer")
sql_query(
    "win_lag_growth",
    "orders",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT month, o_orderstatus, n, n - lag(n) OVER (PARTITION BY o_orderstatus ORDER BY month) AS change FROM m""",
)
sql_query(
    "win_running_total",
    "orders",
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders",
)
sql_query(
    "win_moving_avg",
    "events",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3,
              round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING), 6) AS mean7 FROM events""",
)
sql_query(
    "win_over_aggregate",
    "orders",
    """SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, CAST(sum(sum(CAST(o_totalprice AS DECIMAL(14,2)))) OVER (PARTITION BY o_orderstatus ORDER BY date_trunc('month', o_orderdate)) AS DOUBLE) AS upto
       FROM orders GROUP BY o_orderstatus, date_trunc('month', o_orderdate)""",
)
sql_query(
    "win_distinct_cumulative",
    "events",
    """WITH firsts AS (SELECT user_id, min(date_trunc('day', ts)) AS day FROM events GROUP BY user_id), d AS (SELECT day, count(*) AS fresh FROM firsts GROUP BY day)
       SELECT day, fresh, CAST(sum(fresh) OVER (ORDER BY day) AS BIGINT) AS users FROM d""",
)
sql_query("win_share", "customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(count(DISTINCT c_custkey)) OVER (PARTITION BY c_nationkey) AS BIGINT) AS of_nation FROM customer GROUP BY c_nationkey, c_mktsegment")

# Sorting, sets, subqueries
sql_query("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("limit_offset", "part", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10 OFFSET 5")
sql_query("union_all", "customer supplier", "SELECT 'c' AS kind, c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's' AS kind, s_nationkey AS nation FROM supplier WHERE s_acctbal < 0")
sql_query("union_distinct", "customer supplier", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 500 UNION SELECT s_nationkey AS nation FROM supplier")
sql_query("set_intersect", "customer supplier", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000")
sql_query("set_except", "customer supplier", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 8000")
sql_query(
    "cte_multi",
    "orders customer",
    """WITH spend AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey),
       top AS (SELECT * FROM spend WHERE n >= 10), named AS (SELECT c.c_name, t.n, t.total FROM top t JOIN customer c ON c.c_custkey = t.o_custkey)
       SELECT c_name, n, total FROM named WHERE total > 1000""",
)
sql_query("scalar_subquery", "part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT max(p_retailprice) * 0.9 FROM part)")
sql_query("correlated_subquery", "part", "SELECT p.p_partkey FROM part p WHERE p.p_size = (SELECT max(q.p_size) FROM part q WHERE q.p_brand = p.p_brand)")
sql_query("derived_table", "lineitem", "SELECT d.l_orderkey, d.qty FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY l_orderkey) d WHERE d.qty > 150")
sql_query("quoted_identifier", "nation", "SELECT n_name AS `company.name` FROM nation", 'SELECT n_name AS "company.name" FROM nation')

# Scalar functions
sql_query(
    "fn_strings",
    "part",
    """SELECT p_partkey, p_brand || '/' || p_type AS joined, concat_ws('', p_brand, NULL, left(p_name, 4)) AS skipped, length(p_name) AS n, trim('  x ') AS t, lower(p_brand) AS lo, upper(p_name) AS up,
              replace(p_type, ' ', '_') AS r, substring(p_name, 2, 3) AS sub FROM part""",
    """SELECT p_partkey, p_brand || '/' || p_type AS joined, concat(p_brand, NULL, left(p_name, 4)) AS skipped, CAST(length(p_name) AS INTEGER) AS n, trim('  x ') AS t, lower(p_brand) AS lo, upper(p_name) AS up,
              replace(p_type, ' ', '_') AS r, substring(p_name, 2, 3) AS sub FROM part""",
)
sql_query(
    "fn_math",
    "part",
    """SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(round(CAST(p_retailprice AS DECIMAL(12,3)), 1) AS DOUBLE) AS r, p_retailprice / nullif(p_size - 10, 0) AS ratio, coalesce(nullif(p_size, 10), -1) AS c,
              try_cast('12x' AS INTEGER) AS bad, CAST('42' AS INTEGER) AS good, CAST('7' AS BIGINT) AS b FROM part""",
)


@register(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m, CAST(extract(quarter FROM o_orderdate) AS INTEGER) AS q,
              CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow, date_diff('month', TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS months, date_diff('year', TIMESTAMP '1995-06-15 00:00:00', o_orderdate) AS years,
              date_diff('quarter', TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS quarters, date_diff('day', TIMESTAMP '1995-01-15 12:00:00', o_orderdate) AS days,
              CAST(epoch(o_orderdate - TIMESTAMP '1995-01-15 00:00:00') AS BIGINT) AS secs, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS later, date_trunc('week', o_orderdate) AS week, strftime(o_orderdate, '%Y%m%d') AS day_text
       FROM orders"""
)
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions with the meaning that users of the pipelines expect: Sunday is 0, differences count boundaries."""
    at = F.col("o_orderdate")
    since = lambda unit, start: dialect.date_diff(unit, F.lit(start).cast("timestamp_ntz"), at)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date(at).alias("d"),
        F.year(at).alias("y"),
        F.month(at).alias("m"),
        F.quarter(at).alias("q"),
        dialect.day_of_week(at).alias("dow"),
        since("month", "1995-01-15 00:00:00").alias("months"),
        since("year", "1995-06-15 00:00:00").alias("years"),
        since("quarter", "1995-01-15 00:00:00").alias("quarters"),
        since("day", "1995-01-15 12:00:00").alias("days"),
        dialect.seconds_between(F.lit("1995-01-15 00:00:00").cast("timestamp_ntz"), at).alias("secs"),
        F.to_date(at + F.expr("INTERVAL '7' DAY")).alias("later"),
        F.date_trunc("week", at).alias("week"),
        F.date_format(at, "yyyyMMdd").alias("day_text"),
    )


sql_query(
    "fn_json",
    "events",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS INTEGER) AS k FROM events WHERE get_json_object(props, '$.k') IS NOT NULL",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
