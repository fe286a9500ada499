"""Sources, sinks, resilience, functions and masking."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialect, masking, names, udfs
from tidemark.sources import registry, resilience, rest


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        seen = 0

        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            Handler.seen += "flaky" in self.path
            if "flaky" in self.path and Handler.seen == 1:
                self.send_response(503)
                self.end_headers()
                return
            page = int(q.get("page", ["1"])[0])
            if "values" in self.path:
                body = {"values": [["id", "name"], ["1", "a"], ["x", "b"], ["3"]]}
            elif "endless" in self.path:
                size, total = int(q["per_page"][0]), int(q["since"][0])
                body = [{"id": n, "who": None} for n in range((page - 1) * size, min(total, page * size))]
            elif "digest" in self.path and not self.headers.get("Authorization", "").startswith('Digest username="u"'):
                self.send_response(401)
                self.send_header("WWW-Authenticate", 'Digest realm="r", nonce="n", qop="auth"')
                self.end_headers()
                return
            elif "products" in self.path:
                body = {"products": [{"id": page}]}
            else:
                body = {"data": {"items": [{"id": 10 * page + n, "who": {"name": f"n{n}"}} for n in range(2)]}}
            self.send_response(200)
            if "products" in self.path and page < 3:
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/products?page={page + 1}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_rest_pages_are_partitions(spark, server, rows):
    df = registry.read(spark, "rest", {"url": f"{server}/flaky", "pages": 3, "data_path": "data.items", "schema": "id int, `who.name` string"})
    assert df.rdd.getNumPartitions() == 3
    assert rows(df) == [(10 * p + n, f"n{n}") for p in (1, 2, 3) for n in (0, 1)]


@pytest.mark.parametrize(("total", "parallel"), [(0, 1), (7, 1), (8, 3), (9, 3), (25, 2)])
def test_rest_reads_to_the_end(spark, server, rows, total, parallel):
    options = {"url": f"{server}/endless", "pagination": "page", "page_size": 4, "parallel": parallel, "cursor_param": "since", "cursor_value": total, "schema": "id int"}
    df = registry.read(spark, "rest", options)
    assert df.rdd.getNumPartitions() == parallel and rows(df) == sorted(((n,) for n in range(total)), key=repr)


def test_rest_authentication(spark, server):
    options = {"url": f"{server}/digest", "data_path": "data.items", "schema": "id int", "auth_type": "digest", "username": "u", "password": "p"}
    assert registry.read(spark, "rest", options).count() == 2
    with pytest.raises(Exception, match="401"):
        registry.read(spark, "rest", options | {"auth_type": "bearer", "token": "t"}).collect()
    with pytest.raises(rest.PageError, match="none of basic"):
        rest.auth_headers({"auth_type": "oauth"})
    with pytest.raises(rest.PageError, match="pagination"):
        registry.read(spark, "rest", options | {"pagination": "pages"})


def test_rest_says_what_is_missing(spark, server):
    with pytest.raises(Exception, match="no 'rows' on the way"):
        registry.read(spark, "rest", {"url": server, "data_path": "data.rows", "schema": "id int"}).collect()


def test_shop_follows_links(spark, server, rows):
    df = registry.read(spark, "shopify", {"shop": "s", "access_token": "t", "endpoint": "products", "schema": "id int", "base_url": server, "per_minute": 100_000})
    assert rows(df) == [(1,), (2,), (3,)]


def test_sheet_casts_text(spark, server, rows):
    df = registry.read(spark, "google_sheets", {"spreadsheet_id": "i", "access_token": "t", "schema": "id int, name string", "base_url": server})
    assert rows(df) == sorted([(1, "a"), (None, "b"), (3, None)], key=repr)


def test_authentication_headers():
    assert rest.auth_headers({"auth_type": "basic", "username": "u", "password": "p"})["Authorization"].startswith("Basic ")
    assert rest.auth_headers({"auth_type": "bearer", "token": "t"}) == {"Authorization": "Bearer t"}
    assert rest.auth_headers({"auth_type": "api_key", "api_key": "k"}) == {"X-API-Key": "k"}


def test_options_are_checked():
    assert registry.option_errors("nope", {}) == [f"type 'nope' is none of {', '.join(sorted(registry.SPECS))}"]
    assert len(registry.option_errors("postgres", {"sync_mode": "sometimes", "destination_sync_mode": "merge"})) == 5
    assert registry.merged("csv", {"path": "a", "delimiter": ";"}, {"path": "b"}) == {**registry.SPECS["csv"].defaults, "path": "b", "delimiter": ";"}


def test_jdbc_options():
    o = registry.merged("postgres", {"host": "h", "database": "d", "table": "t", "user": "u"})
    assert registry.jdbc_options(o) == {"url": "jdbc:postgresql://h:5432/d", "fetchsize": "10000", "user": "u", "dbtable": "public.t"}
    o = registry.merged("postgres", {"url": "jdbc:x", "query": "SELECT 1", "partition_column": "id", "lower_bound": 0, "upper_bound": 9})
    assert registry.jdbc_options(o)["dbtable"] == "(SELECT 1) q"
    with pytest.raises(ValueError, match="not a plain name"):
        registry.jdbc_options(registry.merged("postgres", {"host": "h", "database": "d", "table": "t; DROP TABLE t"}))


def test_object_store_by_any_scheme(spark, tmp_path, rows):
    spark.range(3).write.json(str(tmp_path / "j"))
    o = {"uri": f"file://{tmp_path}/j", "file_format": "jsonl"}
    assert rows(registry.read(spark, "s3", o)) == [(0,), (1,), (2,)]
    spark.range(2).repartition(2).write.parquet(str(tmp_path / "p"))
    spark.range(1).write.mode("append").parquet(str(tmp_path / "p"))
    assert registry.read(spark, "s3", {"uri": f"file://{tmp_path}/p", "max_files": 10}).count() == 3
    registry.write(spark.range(2), "s3", {"uri": f"file://{tmp_path}/w", "file_format": "csv"})
    assert spark.read.csv(f"{tmp_path}/w", header=True).count() == 2


def test_files_cannot_be_upserted(spark, tmp_path):
    with pytest.raises(registry.SourceError, match="upserted"):
        registry.write(spark.range(1), "csv", {"path": str(tmp_path / "x"), "mode": "upsert"})


@pytest.mark.parametrize(("values", "cursor", "left"), [(["2024-01-02", "2024-01-10", None], "2024-01-05", 1), (["9", "10", "100"], "10", 1), (["a", "c"], "b", 1), (["1"], None, 1)])
def test_text_cursors(spark, values, cursor, left):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert registry.after_cursor(df, "c", cursor).count() == left


def test_next_cursor_never_goes_back(spark):
    df = spark.createDataFrame([("9",), ("10",), (None,)], "c string")
    assert registry.next_cursor(df, "c", "1") == "10"
    assert registry.next_cursor(df.limit(0), "c", "7") == "7"


def test_memory_source(spark, rows):
    registry.write(spark.range(2), "memory", {"name": "held"})
    assert rows(registry.read(spark, "memory", {"name": "held", "filters": [("id", ">", 0)]})) == [(1,)]


def test_retry_breaker_and_limiter():
    calls, waits = [], []

    def fails(n):
        calls.append(1)
        if len(calls) < n:
            raise ConnectionError
        return "ok"

    assert resilience.Retry(sleep=waits.append).call(fails, 3) == "ok" and 1.8 <= waits[1] <= 2.2
    now = [0.0]
    b = resilience.CircuitBreaker(failures=2, pause=10, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(resilience.CircuitOpenError):
        b.call(lambda: 1)
    now[0] = 11
    assert (b.call(lambda: 1), b.state, b.call(lambda: 2), b.state) == (1, "half_open", 2, "closed")
    r = resilience.RateLimiter(per_minute=60, burst=2, policy="drop", clock=lambda: now[0])
    r.acquire(), r.acquire()
    with pytest.raises(resilience.RateLimitedError):
        r.acquire()
    now[0] += 1
    r.acquire()


def test_names_and_literals():
    assert names.check_name("a.b_1") == "a.b_1" and names.quote("a`b") == "`a``b`"
    for bad in ("select", "a b", "1a", "a;b", ""):
        with pytest.raises(ValueError):
            names.check_name(bad)
    assert [names.literal(x) for x in (None, True, 1.5, "a'b")] == ["NULL", "TRUE", "1.5", "'a\\'b'"]


def test_masking_of_logs():
    assert masking.mask_text("a@b.com password=x1 10.0.0.1 123-45-6789") == "[EMAIL] password=[PASSWORD] [IP] [SSN]"
    assert masking.mask_fields({"token": "t", "a": {"note": "call 555-123-4567"}, "l": ["x@y.org", 1]}) == {"token": "[REDACTED]", "a": {"note": "call [PHONE]"}, "l": ["[EMAIL]", 1]}


def test_dialect_units(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    out = spark.range(1).select(*[dialect.date_diff(u, at("2023-12-31 23:59:59"), at("2024-01-01 00:00:00")).alias(u) for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")], dialect.concat(F.lit("a"), F.lit(None)).alias("c"), dialect.half_up_int(F.lit(2.5)).alias("h"), dialect.divide(F.lit(1), F.lit(0)).alias("z")).first()
    assert tuple(out) == (1, 1, 1, 1, 1, 1, 1, 1, "a", 3, None)


def test_functions_keep_their_contract(spark):
    with pytest.raises(udfs.UdfError, match="defaults"):
        udfs.table_udf(schema="a int")(lambda pdf, x: pdf)
    local = udfs.table_udf(schema="b long", required=("a",), row_local=True)(lambda pdf: pdf.rename(columns={"a": "b"}))
    with pytest.raises(udfs.UdfError, match="needs columns a"):
        local(spark.range(1))
    assert local(spark.range(3).toDF("a")).count() == 3
    whole = udfs.table_udf(schema="b long")(lambda pdf: pdf)
    with pytest.raises(udfs.UdfError, match="row-local"):
        whole(spark.range(1))
    with pytest.raises(Exception, match="returned no columns"):
        whole(spark.range(1).toDF("a"), by=["a"]).collect()
    @udfs.table_udf(schema="k long, n long, total long")
    def totals(pdf):
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)], "total": [pdf["v"].sum()]}).astype({"k": "Int64"})

    data = spark.range(40_000).select(F.when(F.col("id") % 7 != 3, F.when(F.col("id") < 25_000, -1).otherwise(F.col("id") % 500)).alias("k"), F.col("id").alias("v"))
    expected = {tuple(r) for r in data.groupBy("k").agg(F.count("*"), F.sum("v")).collect()}
    got = [(None if r["k"] is None else int(r["k"]), r["n"], r["total"]) for r in totals(data, by=["k"]).collect()]
    assert set(got) == expected and len(got) == len(expected)
    text = data.withColumn("k", F.col("k").cast("string"))
    named = udfs.table_udf(schema="k string, n long")(lambda pdf: pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)]}))
    assert {(r["k"], r["n"]) for r in named(text, by=["k"]).collect()} == {(None if k is None else str(k), n) for k, n, _ in expected}
    assert totals(data.limit(0), by=["k"]).count() == 0
    assert udfs.infer_schema(lambda pdf: pd.DataFrame({"x": pdf["id"] * 2.0}), spark.range(3)).simpleString() == "struct<x:double>"
    assert "services.shout" in udfs.discover("tidemark.queries")


def test_shared_folder_without_a_setting(spark):
    from types import SimpleNamespace

    from tidemark.sources import shared

    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(applicationId="a1", master=master))
    assert shared.shared_dir(bare("local[4]")) == shared.shared_dir(bare("local")) != shared.shared_dir(spark)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            shared.shared_dir(bare(master))
