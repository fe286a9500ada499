"""A training corpus from raw documents: five stages over the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, linededup, mixing, neardup
from tidemark.llm.catalog import MIX_WEIGHTS, documents, mix_domain
from tidemark.llm.scratch import new_path, remove, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null and letterless texts are rejected.  lang becomes what was predicted.

    Rows are judged one by one, so repeated rows and ties stay as they are.
    """
    found = langid.identify(docs).filter(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; one that loses all of its lines goes.

    Rows equal in id and text are one document; of copies the one with the
    smallest id (nulls last), then hash of the text, stays.
    """
    found = linededup.dedup_lines(docs)
    kept = found.filter((F.size("deleted") == 0) | F.col("text").rlike(linededup.SOLID))
    return kept.withColumn("n_chars", F.when(F.size("deleted") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of texts whose five-word shingles have a Jaccard similarity of 0.8.

    SimHash classes come first, checked on whole texts.  They can't give it all: near copies of that similarity
    differ in about ten of 64 bits (see README), so MinHash bands propose further pairs (neardup.py).
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages; rows are judged one by one."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contamination.contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each selected document with its domain, tokens and number of copies.

    Equal rows tie in the seeded order and are taken one after the other.
    """
    return mixing.mix(docs, mix_domain(), MIX_WEIGHTS).select(*docs.columns, "domain", "tokens", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("mixture", mix_sources),
]

#: Language prediction and fingerprints can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again; a stage's table goes when the next one is written."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", path)
        if last:
            remove(spark, last)
        last = path
    return docs
