"""REST sources as Spark data sources, read by the tasks themselves.

Without ``pagination`` an endpoint is asked once.  With ``page`` its numbered
pages are read until one is empty or short; ``parallel`` partitions take every
k-th page each.  A number of ``pages`` reads just these, a partition each.  With
``link`` each page names the next.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.resilience import RateLimiter, Retry

DEFAULTS = {"method": "GET", "pagination": "none", "pages": 0, "parallel": 1, "page_param": "page", "size_param": "per_page", "page_size": 100, "first_page": 1, "data_path": "", "timeout": 30, "tries": 3, "per_minute": 600}
SHOP_DEFAULTS = {"api_version": "2024-01", "limit": 250, "per_minute": 90, "tries": 3, "timeout": 30}
SHEET_DEFAULTS = {"range": "Sheet1", "has_header": True, "tries": 3, "timeout": 30}


class PageError(RuntimeError):
    """A page that can't be read, or has no rows where they should be."""


def auth_headers(o: dict) -> dict[str, str]:
    """Headers of basic, bearer and API-key authentication; digest needs the server's challenge first: see fetch()."""
    kind = o.get("auth_type") or "none"
    if kind not in ("none", "basic", "bearer", "api_key", "digest"):
        raise PageError(f"auth_type {kind!r} is none of basic, bearer, api_key, digest")
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{o['username']}:{o['password']}".encode()).decode()}
    if kind == "bearer":
        return {"Authorization": f"Bearer {o['token']}"}
    if kind == "api_key":
        return {o.get("api_key_header", "X-API-Key"): o["api_key"]}
    return {}


def fetch(url: str, o: dict) -> tuple[object, dict[str, str]]:
    """JSON of a url and its response headers; server errors are tried again, others are not."""

    def once():
        data = o["body"].encode() if o.get("body") else None
        request = urllib.request.Request(url, data=data, method=o.get("method", "GET"), headers={"Accept": "application/json", **auth_headers(o), **json.loads(o.get("headers") or "{}")})
        handlers = []
        if o.get("auth_type") == "digest":
            passwords = urllib.request.HTTPPasswordMgrWithDefaultRealm()
            passwords.add_password(None, url, o["username"], o["password"])
            handlers = [urllib.request.HTTPDigestAuthHandler(passwords)]
        try:
            with urllib.request.build_opener(*handlers).open(request, timeout=float(o["timeout"])) as response:
                return json.load(response), dict(response.headers)
        except urllib.error.HTTPError as e:
            if e.code >= 500 or e.code == 429:
                raise ConnectionError(f"{url}: {e.code}") from e
            raise PageError(f"{url}: {e.code}") from None

    return Retry(tries=int(o["tries"]), on=(ConnectionError, TimeoutError, urllib.error.URLError)).call(once)


def rows_at(data: object, path: str) -> list[dict]:
    """The rows below a dotted path; an object counts as one row."""
    for name in filter(None, path.split(".")):
        if not isinstance(data, dict) or name not in data:
            raise PageError(f"no {name!r} on the way to {path!r}")
        data = data[name]
    return data if isinstance(data, list) else [data]


def dig(row: dict, dotted: str):
    """A value by dotted name: a key of that name, else a nested one; other types than text as JSON for text columns."""
    if dotted in row:
        return row[dotted]
    for name in dotted.split("."):
        row = row.get(name) if isinstance(row, dict) else None
    return row


def with_query(url: str, values: dict) -> str:
    """A url with more query parameters."""
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(values)}" if values else url


class _Pages(InputPartition):
    """Pages from ``value`` on, every ``step``-th up to ``last``, or to the end where that is None; no step: one unnumbered request."""

    def __init__(self, value: int, step: int, last: int | None):
        super().__init__(value)
        self.step, self.last = step, last


class _PagesReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.options = schema.names, options

    def partitions(self):
        o = self.options
        first, pages, parallel = int(o["first_page"]), int(o["pages"]), int(o["parallel"])
        if pages:
            return [_Pages(p, 1, p) for p in range(first, first + pages)]
        if o["pagination"] == "page":
            return [_Pages(first + k, parallel, None) for k in range(parallel)]
        return [_Pages(first, 0, first)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        o, page = self.options, partition.value
        while partition.last is None or page <= partition.last:
            numbers = {o["page_param"]: page, o["size_param"]: o["page_size"]} if partition.step else {}
            data, _ = fetch(with_query(o["url"], numbers), o)
            rows = rows_at(data, o["data_path"])
            for row in rows:
                yield tuple(dig(row, name) for name in self.names)
            if partition.last is None and len(rows) < int(o["page_size"]):
                return
            page += partition.step or 1


class PagesSource(DataSource):
    """Numbered pages of a JSON endpoint, or its only one."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def reader(self, schema):
        return _PagesReader(schema, DEFAULTS | dict(self.options))


class _CursorReader(DataSourceReader):
    """Pages whose address is only known from the page before: one partition."""

    def __init__(self, schema, options: dict):
        self.names, self.options = schema.names, options

    def read(self, partition) -> Iterator[tuple]:
        o, url = self.options, self.options["url"]
        limiter = RateLimiter(per_minute=float(o["per_minute"]), burst=2)
        while url:
            limiter.acquire()
            data, headers = fetch(url, o)
            for row in rows_at(data, o["data_path"]):
                yield tuple(dig(row, name) for name in self.names)
            url = next_link(headers.get("Link", ""))


def next_link(header: str) -> str | None:
    """The address of rel="next" in a Link header."""
    for part in header.split(","):
        address, _, rest = part.partition(";")
        if 'rel="next"' in rest:
            return address.strip().strip("<>")
    return None


class LinkedPagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linked_json_pages"

    def reader(self, schema):
        return _CursorReader(schema, DEFAULTS | dict(self.options))


def _load(spark: SparkSession, source: type[DataSource], o: dict) -> DataFrame:
    spark.dataSource.register(source)
    flat = {k: v if isinstance(v, str) else json.dumps(v) for k, v in o.items() if k != "schema" and v is not None}
    return spark.read.format(source.name()).schema(o["schema"]).options(**flat).load()


def read(spark: SparkSession, o: dict) -> DataFrame:
    """Rows of an endpoint; ``schema`` may use dotted names in backticks for nested values.

    ``cursor_value`` is sent as ``cursor_param`` where both are given.
    """
    if o.get("pagination", "none") not in ("none", "page", "link"):
        raise PageError(f"pagination {o['pagination']!r} is none of none, page, link")
    if o.get("cursor_param") and o.get("cursor_value") is not None:
        o = o | {"url": with_query(o["url"], {o["cursor_param"]: o["cursor_value"]})}
    return _load(spark, LinkedPagesSource if o.get("pagination") == "link" else PagesSource, o)


def read_shop(spark: SparkSession, o: dict) -> DataFrame:
    """An endpoint of a shop's admin API; ``since_id`` is the incremental cursor."""
    query = urllib.parse.urlencode({"limit": o["limit"], **({"since_id": o["since_id"]} if o.get("since_id") else {})})
    base = o.get("base_url") or f"https://{o['shop']}.myshopify.com"
    url = f"{base}/admin/api/{o['api_version']}/{o['endpoint']}.json?{query}"
    return _load(spark, LinkedPagesSource, DEFAULTS | o | {"url": url, "data_path": o["endpoint"], "headers": {"X-Shopify-Access-Token": o["access_token"]}})


def read_sheet(spark: SparkSession, o: dict) -> DataFrame:
    """A range of a spreadsheet; the first row names the columns if ``has_header``.  Values are text cast to the schema."""
    base = o.get("base_url") or "https://sheets.googleapis.com"
    url = f"{base}/v4/spreadsheets/{o['spreadsheet_id']}/values/{urllib.parse.quote(o['range'])}"
    data, _ = fetch(url, DEFAULTS | o | {"auth_type": "bearer", "token": o["access_token"]})
    values = data.get("values", [])
    schema = spark.createDataFrame([], o["schema"]).schema
    names = values[0] if o["has_header"] and values else schema.names
    body = values[1:] if o["has_header"] else values
    rows = [tuple(dict(zip(names, row, strict=False)).get(n) for n in schema.names) for row in body]  # a sheet is small
    text = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{n}` string" for n in schema.names))
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
