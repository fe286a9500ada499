"""A deterministic sharded WARC writer, and its reader.

Records are sorted by page id over the whole table, compressed one by one
(a gzip member each) and dealt to files by compressed size: the file of a record
is its offset in the sorted stream of all compressed records, divided by
``roll_bytes``.  Records are made twice: a first pass keeps their sizes alone,
whose sort gives the offsets and the first record of every file; a second pass
makes them again, knows their files from these bounds, and moves each compressed
record once, to the task of its file.  So no compressed record is stored beside
the archive, files do not depend on how Spark partitions the input, and equal
input gives equal archives.

Files are written by Spark's text writer, as raw bytes with a one-byte record
separator: a gzip member ends with the top byte of its length, which is zero
below 16 MiB, and a larger record is followed by an empty member, which ends in
zero too.  That zero is left off and the separator puts it back.  This needs no
file system but Hadoop's, and task attempts commit through its temporary names.
The driver then renames whole files into a folder of this run and commits the
archive by renaming its manifest over the old one; a reader takes the files that
the manifest names, so it sees the old archive or the new one, never a mixture.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import hadoop_path, new_path, put_text, remove, written

#: WARC-Date of all records: a crawl time would go here; archives must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to and refers_url.

    Of pages with equal payloads of at least ``least_bytes``, the smallest id is
    the response and others refer to it; rows that tie for the smallest id, or
    have a null id only, are all responses.  A null html is an empty payload.
    The digest's copies are counted before they meet, and the join back to the
    pages can be split where a third of all pages are alike.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    known = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("_digest"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = known.agg(F.min(named).alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    first = written(first, "warc-firsts")  # of repeated payloads only; its size says whether payloads have to move
    out = rows.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least_bytes), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.page_id")).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("refers_url"),
    )


def _uri(url: str) -> str:
    """A url without bytes that would end a header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record, uncompressed.  A revisit has the HTTP headers of the full payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        lines += [f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"] if refers_url is not None else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that depends on data alone and ends with a zero byte."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + member(b"")


#: What records are sorted by, nulls first.  Rows that are equal in these are the same record.
ORDER = ("page_id", "digest", "url")
_COLUMNS = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "refers_url")


def _members(batch: pd.DataFrame) -> Iterator[tuple[int | None, object, bytes]]:
    """Page id, row and gzip member of each row."""
    none = batch.astype(object).where(batch.notna(), None)
    for r in none.itertuples(index=False):
        page_id, refers_to = (None if x is None else int(x) for x in (r.page_id, r.refers_to))
        yield page_id, r, member(record(page_id, r.url, bytes(r.payload), r.payload_digest, r.record_type, refers_to, r.refers_url))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(page_id, r.payload_digest, r.url, len(data)) for page_id, r, data in _members(batch)]
        yield pd.DataFrame(rows, columns=[*ORDER, "size"]).astype({"page_id": "Int64"})


def _place(page_id, digest: str, url: str | None) -> tuple:
    """A row's place in the order, with nulls first."""
    none = page_id is None or page_id != page_id
    return not none, 0 if none else int(page_id), digest, url is not None, url or ""


def _builder(starts: list[tuple]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Makes records with the number of their file: from the first record of each file, or as rows say, ``copies`` times."""
    places = [_place(*s) for s in starts]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, r, data in _members(batch):
                file = bisect_right(places, _place(page_id, r.payload_digest, r.url)) - 1 if r.file is None else int(r.file)
                row = (file, page_id, r.payload_digest, r.url, data)
                for _ in range(int(r.copies)):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield _built(rows)
                        rows = []
            yield _built(rows)

    return build


def _built(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", *ORDER, "data"]).astype({"page_id": "Int64", "file": "int32"})


def write(records: DataFrame, path: str, prefix: str = "crawl", roll_bytes: int = 64 << 20, most_tasks: int = 20_000) -> dict:
    """Write records (see resolve_revisits) as files prefix-NNNNN.warc.gz of a new folder below path, commit path/manifest.json, and return it.

    A record belongs to the file in which it starts, so a file exceeds
    ``roll_bytes`` by less than one record.  An empty table gives a manifest
    without files.  Rows are ordered by id (nulls first), digest and url; equal
    rows are counted, so that any number of them is spread over files.  Each file
    is a task's work, or several files in a row beyond ``most_tasks`` files.
    What the driver handles is a row and a rename for each file.  The archive
    before stays readable until the next write after this one.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes_at, placed_at, repeats_at = (new_path(spark, f"warc-{name}") for name in ("sizes", "placed", "repeats"))
    made = records.select(*_COLUMNS)
    sizes = written(made.mapInPandas(_sizes, "page_id long, digest string, url string, size long"), "warc-sizes", sizes_at)

    # offsets in the sorted stream, from sizes alone
    counted = sizes.groupBy(*ORDER).agg(F.max("size").alias("size"), F.count("*").alias("n"))
    counted = written(counted.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), "warc-placed", placed_at)
    sums = counted.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before.alias("before"))  # a row for each partition
    inside = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("inside", inside).join(F.broadcast(sums), "part").withColumn("at", F.col("before") + F.col("inside"))
    # the copies of a row go to all files from its first one's to its last one's
    pieces = F.expr(f"sequence(at div {roll_bytes}, (at + (n - 1) * size) div {roll_bytes})")
    placed = placed.select(*ORDER, "size", "n", "at", F.explode(pieces).alias("piece"))
    copies = F.expr(f"least(n, ((piece + 1) * {roll_bytes} - at + size - 1) div size) - greatest(0L, (piece * {roll_bytes} - at + size - 1) div size)")
    placed = placed.withColumn("copies", copies).filter("copies > 0")
    per_file = placed.groupBy("piece").agg(
        F.sum("copies").alias("records"), F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.min(F.struct(*ORDER)).alias("start"), F.min("page_id").alias("first"), F.max("page_id").alias("last")
    )
    found = per_file.orderBy("piece").collect()
    run = uuid.uuid4().hex
    temporary = f"{path}/{run}/_temporary"
    files = [{"name": f"{run}/{prefix}-{at:05d}.warc.gz", **{k: r[k] for k in ("records", "bytes", "first", "last")}} for at, r in enumerate(found)]
    if files:
        build, kind = _builder([tuple(r["start"]) for r in found]), "file int, page_id long, digest string, url string, data binary"
        repeats = written(placed.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ORDER], "piece", "copies"), "warc-repeats", repeats_at)
        same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("payload_digest") == F.col("_digest")) & F.col("url").eqNullSafe(F.col("_url"))
        once = made
        if not repeats.isEmpty():
            known = repeats.select("_page_id", "_digest", "_url").distinct()
            once = made.join(known, same, "left_anti")
            one = made.join(known, same, "left_semi").groupBy("page_id", "url", "payload_digest").agg(*[F.first(c).alias(c) for c in _COLUMNS if c not in ("page_id", "url", "payload_digest")])
            numbers = spark.createDataFrame([(r["piece"], at) for at, r in enumerate(found)], "piece long, file int")
            again = one.join(repeats.join(numbers, "piece"), same).select(*_COLUMNS, "file", "copies").mapInPandas(build, kind)
        lines = once.select(*_COLUMNS, F.lit(None).cast("int").alias("file"), F.lit(1).cast("long").alias("copies")).mapInPandas(build, kind)
        if not repeats.isEmpty():
            lines = lines.unionByName(again)
        tasks = min(len(files), most_tasks)
        lines = lines.repartitionById(tasks, F.expr(f"cast(cast(file AS long) * {tasks} div {len(files)} AS int)")).sortWithinPartitions("file", *ORDER)
        raw = lines.select("file", F.expr("cast(substring(data, 1, length(data) - 1) as string)").alias("value"))
        raw.write.partitionBy("file").option("lineSep", "\0").text(temporary)
        for at, f in enumerate(files):
            _rename_only_file(spark, f"{temporary}/file={at}", f"{path}/{f['name']}")
    for done in (temporary, sizes_at, placed_at, repeats_at):
        remove(spark, done)
    before = _manifest(spark, path)
    manifest = {"files": files, "roll_bytes": roll_bytes, "run": run, "previous": before["run"] if before else None}
    put_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    if before and before["previous"]:
        remove(spark, f"{path}/{before['previous']}")
    return manifest


def _manifest(spark: SparkSession, path: str) -> dict | None:
    fs, where = hadoop_path(spark, f"{path}/manifest.json")
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]) if fs.exists(where) else None


def _rename_only_file(spark: SparkSession, folder: str, to: str) -> None:
    fs, where = hadoop_path(spark, folder)
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
    if len(found) != 1:
        raise RuntimeError(f"{folder} holds {len(found)} files, not one")
    _, target = hadoop_path(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(found[0], target):
        raise RuntimeError(f"{found[0]} could not be renamed to {to}")


def members(data: bytes, chunk: int = 8192) -> Iterator[bytes]:
    """The content of each gzip member that is not empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            part = view[at : at + chunk]
            parts.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        if content := b"".join(parts):
            yield content


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP headers and payload of a record; raises ValueError if its lengths or digests are wrong."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    length = int(fields["Content-Length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has a wrong length")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has a wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has a wrong payload digest")
    return fields, http, payload


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for data in members(bytes(content)):
                fields, http, _ = parse(data)
                full = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                rows.append((_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), full, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], _number(fields.get("WARC-Refers-To"))))
                if len(rows) == 10_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the files in path/manifest.json, with lengths and digests verified."""
    names = [f["name"] for f in _manifest(spark, path)["files"]]
    if not names:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").load([f"{path}/{name}" for name in names]).select("content")
    return files.mapInPandas(_read, RECORD)
