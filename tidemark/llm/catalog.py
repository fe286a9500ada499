"""Queries of the subpackage and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, licenses, linededup, mixing, mpeg, pii, simhash, urls, warc
from tidemark.llm.licenses import dice_sql
from tidemark.llm.scratch import new_path
from tidemark.llm.sql import DECONTAMINATE_SQL, LINE_RUNS_SQL, WARC_SQL, mix_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Production parameters of the mixture.
MIX_WEIGHTS = {
    "domain": {"web": 0.5, "books": 0.3, "forum": 0.2},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def mix_domain():
    """The domain of a source: by a hash of its name, a third of all sources each."""
    part = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, MIX_WEIGHTS["domain"])), part % 3 + 1)


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query(mix_sql(MIX_WEIGHTS))
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), mix_domain(), MIX_WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", "tokens", "epochs", "copies")


@query(DECONTAMINATE_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        "contamination.contaminated",
    )


@query(LINE_RUNS_SQL)
def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query()
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query()
def op6_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg.media_table(documents(spark, sf_dir))
    p = "probe."
    read = stored.withColumn("probe", mpeg.probe(F.col("media")))
    feature = F.concat_ws(
        ";",
        F.lit("mp3"),
        *[F.concat(F.lit(f"{name}="), F.col(p + name).cast("string")) for name in ("frames", "samples", "sample_rate", "vbr_frames", "crc_checked", "crc_errors", "resyncs")],
        F.concat(F.lit("last_frame="), F.element_at(F.col(p + "seek_offsets"), -1).cast("string")),
    )
    return read.select(
        "doc_id",
        F.col(p + "tags")["text-bytes"].cast("long").alias("n_bytes"),
        F.octet_length(p + "payload").cast("long").alias("payload_bytes"),
        F.sha2(p + "payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(p + "payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "duration_s",
        F.size("seek_offsets").cast("long").alias("n_offsets"),
        F.sha2(F.array_join(F.col("seek_offsets").cast("array<string>"), ","), 256).alias("offsets_sha256"),
        (F.col("crc_errors") == 0).alias("intact"),
    )


@query(WARC_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.resolve_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path, roll_bytes=16 << 20)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(dice_sql())
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(documents(spark, sf_dir).select("doc_id", "text"))
    hits = F.col("licence_matches")
    return found.select(
        "doc_id",
        F.size(hits).cast("long").alias("n_matches"),
        F.coalesce(F.array_max(hits["dice"]), F.lit(0.0)).alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(hits["license"])), ",").alias("licenses"),
    )


@query()
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    found = urls.filter_urls(pages, pages.join(bad, "page_id").select("url", "bad"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    redacted = pii.redact(F.coalesce("text", F.lit("")), F.col("spans"))
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.sha2(redacted, 256).alias("redacted_sha256"))
