"""Analyses that the pipelines' users write: cohorts, segments, series, outliers."""

from __future__ import annotations

from tidemark.queries.registry import sql_query

sql_query(
    "cohort",
    "orders",
    """WITH firsts AS (SELECT o_custkey, min(date_trunc('month', o_orderdate)) AS cohort FROM orders GROUP BY o_custkey),
       a AS (SELECT f.cohort, 12 * (year(o.o_orderdate) - year(f.cohort)) + month(o.o_orderdate) - month(f.cohort) AS age, count(DISTINCT o.o_custkey) AS customers FROM orders o JOIN firsts f ON o.o_custkey = f.o_custkey GROUP BY 1, 2)
       SELECT cohort, CAST(age AS BIGINT) AS age, customers, CAST(sum(customers) OVER (PARTITION BY cohort ORDER BY age ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM a""",
)
sql_query(
    "rfm",
    "orders",
    """WITH c AS (SELECT o_custkey, max(o_orderdate) AS latest, count(*) AS frequency, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS monetary FROM orders GROUP BY o_custkey),
       r AS (SELECT o_custkey, frequency, monetary, ntile(5) OVER (ORDER BY latest, o_custkey) AS r, ntile(5) OVER (ORDER BY frequency, o_custkey) AS f, ntile(5) OVER (ORDER BY monetary, o_custkey) AS m FROM c)
       SELECT o_custkey, frequency, monetary, CAST(r AS INTEGER) AS r, CAST(f AS INTEGER) AS f, CAST(m AS INTEGER) AS m, CASE WHEN r >= 4 AND f >= 4 THEN 'champion' WHEN r <= 2 AND f >= 3 THEN 'at risk' ELSE 'other' END AS segment FROM r""",
)
sql_query(
    "time_series",
    "events",
    """WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1)
       SELECT day, n, total, lag(n) OVER (ORDER BY day) AS before, CAST(sum(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d""",
)
sql_query(
    "outlier_zscore",
    "customer",
    """WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS mean, stddev(c_acctbal) AS sd FROM customer GROUP BY c_nationkey)
       SELECT c.c_custkey, round((c.c_acctbal - s.mean) / nullif(s.sd, 0), 4) AS z FROM customer c JOIN s ON c.c_nationkey = s.c_nationkey WHERE abs((c.c_acctbal - s.mean) / nullif(s.sd, 0)) > 1.5""",
)
sql_query(
    "top_per_group",
    "lineitem part",
    """WITH q AS (SELECT p.p_brand, l.l_partkey, CAST(sum(l.l_quantity) AS DOUBLE) AS qty FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)
       SELECT p_brand, l_partkey, qty, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, l_partkey) AS BIGINT) AS rn FROM q) WHERE rn <= 3""",
)
sql_query(
    "pivot_status",
    "orders",
    """SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""",
)
