"""SimHash near-duplicate detection over deletion-variant signatures.

A fingerprint has 64 bits.  With a link distance of 2 it is cut into only two
32-bit segments: two bits of difference leave at least one segment that differs
in one bit at most.  Every segment is therefore indexed under its 32
one-wildcard variants, an equality join proposes pairs that share a variant, and
an exact XOR / bit count verifies them.

Scale notes
-----------
* Fingerprints are made in one map-only pass; copies collapse to one row per
  distinct fingerprint (partial aggregation) before anything is indexed.
* Buckets are never paired off in full.  A bucket with at most ``pair_limit``
  fingerprints is verified by an equality join.  A larger one (a dense cloud of
  near copies) goes to an exact path with no quadratic step: its members are
  re-keyed by their whole fingerprint with two bits deleted; such a key holds
  four values at most and all of them link, so each key needs one star.
* Components come from alternating large-star / small-star rounds on the
  (much smaller) link table, each round cut with ``checkpoint()``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.graph import connected_components
from tidemark.llm.scratch import written

SEED = 42
BLOCK = 1 << 18
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a text; 0 where it has no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and
    every run of ``shingle`` words counts as often as it occurs.  Works in
    blocks, so that memory does not grow with the text beyond its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[8 * j : 8 * j + 8] += np.bincount(octets[:, j], minlength=256) @ _BITS
    value = sum(1 << i for i in range(64) if 2 * counts[i] > n)
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Column form of :func:`fingerprint_of`."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return simhash(text)


def _segment_variants() -> Column:
    """One key for each segment and deleted bit: 6 bits that name both, then the rest of the segment."""
    keys = []
    for segment, bit in itertools.product(range(2), range(32)):
        part = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)))
        keys.append(part.bitwiseOR(F.lit((segment * 32 + bit) << 32)))
    return F.array(*keys)


def _pair_variants(bits: int = 64) -> Column:
    """The fingerprint with every two bits deleted, and which two those were (as a number)."""
    masks = (~((1 << i) | (1 << j)) & (2**64 - 1) for i, j in itertools.combinations(range(bits), 2))
    signed = ", ".join(f"{m - (1 << 64) if m >> 63 else m}L" for m in masks)
    # one expression text: 2,016 column objects would take the driver seconds to make
    return F.expr(f"transform(array({signed}), (mask, at) -> struct(cast(at AS short) AS bits, fp & mask AS rest))")


def links(fingerprints: DataFrame, pair_limit: int = 256) -> DataFrame:
    """Links (a, b) that connect every two fingerprints of at most two differing bits.

    ``fingerprints`` holds distinct values in column fp.  All pairs of a bucket
    of at most ``pair_limit`` values are verified and returned; members of a
    larger one are linked through stars over their two-bit deletions (four
    values at most each), which connects exactly the same values.
    """
    # 64 rows come of one, so small files are dealt to all tasks first
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fingerprints.repartition(parts, "fp").select("fp", F.explode(_segment_variants()).alias("key"))
    shared = variants.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # Spark's size estimate leaves out the 64 rows, so that it would send them all through the driver as a broadcast
    buckets = written(variants.join(shared.hint("merge"), "key").select("key", "fp", "size"), "buckets")
    small = buckets.filter(F.col("size") <= pair_limit).select("key", "fp")
    a, b = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    near = a.join(b, "key").filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b")
    dense = buckets.filter(F.col("size") > pair_limit).select("fp").distinct()
    keyed = dense.select("fp", F.explode(_pair_variants()).alias("variant"))
    stars = keyed.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    near_dense = stars.select("a", F.explode("all").alias("b")).filter("a <> b")
    return near.unionAll(near_dense).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, pair_limit: int = 256) -> DataFrame:
    """One row for each input row: id, fp (signed), component_id, the smallest id reachable.

    Null texts and texts without words have fingerprint zero and are linked like
    any others.  Rows with equal fingerprints link; repeated rows stay.  A null
    id is never a component's name unless all of its ids are null.  An empty
    table gives an empty result.  Other columns of ``docs`` are not looked at.
    """
    base = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp"))
    base = written(base, "fingerprints")
    distinct = written(base.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    named = _components(distinct, pair_limit)
    return base.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _components(distinct: DataFrame, pair_limit: int) -> DataFrame:
    """fp, component (its smallest fingerprint) and component_id (its smallest id) of distinct fingerprints with their smallest ids, rep.

    Fingerprints are the nodes, so those of null ids only still join others.
    """
    near = links(distinct, pair_limit)
    parts = connected_components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, pair_limit: int = 256) -> DataFrame:
    """One row of docs for each near-duplicate component: see :func:`keep_first`."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), fingerprint(F.col(text_col), shingle).alias("fp"))
    base = written(base, "fingerprints")
    distinct = written(base.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    return keep_first(docs, base.join(_components(distinct, pair_limit), "fp"), id_col, text_col)


def keep_first(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs with the smallest id (nulls last), then hash of the text, of every component.

    ``named`` has id, own (hash of the text) and component for each row of docs.
    Rows are judged by their own texts, whether their ids are null or repeated.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "own")
    first = named.groupBy("component").agg(F.min(order).alias("first"))
    rows = named.groupBy("component", "id", "own").agg(F.count("*").alias("_rows")).join(first, "component")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("own") == F.col("first.own"))
    copies = written(rows.select(F.col("id").alias("_id"), F.col("own").alias("_own"), F.when(stays, F.col("_rows")).otherwise(0).alias("_rows")).filter("_rows <> 1"), "copies")
    # copies are usually few, so that the texts need not move to find them
    gone = copies.filter("_rows = 0")
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_own"]), "left_anti")
    if copies.filter("_rows > 1").isEmpty():
        return out
    return out.withColumn("_own", F.xxhash64(text_col)).dropDuplicates([id_col, "_own"]).drop("_own")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
