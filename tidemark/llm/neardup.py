"""Near duplicates by Jaccard similarity of word shingles: SimHash classes and MinHash bands propose pairs, whole texts verify them.

:func:`simhash.near_duplicates` finds the classes of fingerprints of at most two differing
bits; each member is compared with the text that names its class.  MinHash bands propose what
fingerprints that far apart can't show: a text's signature has ``BANDS`` x ``ROWS`` = 40 x 8 minima of its shingles'
hashes.  Two texts of similarity s share a band with probability
1 - (1 - s^8)^40: 0.9994 at 0.8 and more above, 0.003 at 0.3.  A pair that shares
a band is a candidate if its sketches (two bits of each minimum) differ in at
most ``APART`` of 320 places.  At 0.8 those that differ number 48 on average, with a
standard deviation of 6.4, so that less than one pair in 200,000 is lost; at 0.5 it is
120 with 8.7.  Texts that are compared with all others of a bucket (see below) get a finer
sketch of one bit of each of ``FINE`` = 2,048 other minima: 205 of these differ at 0.8 on
average, with a standard deviation of 13.6, and pairs above ``FINE_APART`` = 270
(one in 1,000,000) go.  At 0.7 it is 307 with 16, so one such pair in 90 stays.
What links is decided by the exact similarity of whole texts.

A 64-bit SimHash can't serve alone: at a similarity of 0.8 about ten of its bits
differ (64 arccos(0.89) / pi), so five or six segments of ten to twelve bits
would be needed, and segments that short are shared by unrelated texts.

Scale notes
-----------
* Equal sets count as one; 40 short rows of each are counted to find shared
  bands, only rows of these are kept, and whole sets are made again from the
  compressed texts of candidates.
* Nothing is windowed or collected by band: counts and leading members are
  aggregates joined back, so that a very common band's rows can be split.
* Buckets are first linked to their most central member only (the one that
  shares most bands with others).  Other pairs of a bucket are compared where that and SimHash left its members in different components, so a
  cloud of near copies costs no quadratic step.  That comparison is of sketches,
  in the join's condition: texts that share two thirds of their shingles meet in
  buckets, but few pairs that are not near copies leave the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import simhash
from tidemark.llm.graph import connected_components
from tidemark.llm.scratch import new_path, remove, written

SEED = 42
#: The similarity as a fraction, so that comparisons are exact.
OVER, UNDER = 4, 5
BANDS, ROWS = 40, 8
#: The most places in which the sketches of a pair may differ.
APART = 80
#: The minima of the finer sketch, and the most of its bits that may differ.
FINE, FINE_APART = 2048, 270
_WORDS = BANDS * ROWS // 64
_FITS = f"least(size, other) * {UNDER} >= greatest(size, other) * {OVER}"
_BLOCK = 1 << 9


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, 2**32, (n, 1), np.uint32), random.integers(0, 2**32, (n, 1), np.uint32) | np.uint32(1)


_SIGNATURE, _FINE = _functions(BANDS * ROWS, SEED), _functions(FINE, SEED + 1)


def shingles_of(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles' hashes in order; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths).tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)).view(np.int64)


def minima_of(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _SIGNATURE) -> np.ndarray:
    """Least values of hash functions, by default those of the signature.  Works in blocks, whatever the set's size."""
    mix, odd = functions
    high = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(mix), 2**32 - 1, np.uint32)
    for at in range(0, len(high), _BLOCK):
        block = high[at : at + _BLOCK]
        least = np.minimum(least, ((block ^ mix) * odd).min(axis=1))
    return least


def bands_of(minima: np.ndarray) -> np.ndarray:
    """A hash for each band of a signature."""
    rows = minima.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), at) for at, row in enumerate(rows)], np.uint64).view(np.int64)


def sketch_of(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, multiplied so that all of its bits count: five words of first bits, then five of second ones."""
    two = (minima * np.uint32(0x9E3779B1)) >> np.uint32(30)
    return np.packbits(np.concatenate([two & 1, two >> 1]).astype(np.uint8)).view(np.int64)


def fine_sketch_of(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of FINE further minima."""
    return np.packbits(((minima_of(shingles, _FINE) * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def _fine_apart(a: str, b: str) -> str:
    """SQL for the number of bits in which two finer sketches differ."""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(FINE // 64))


def _apart(a: str, b: str) -> str:
    """SQL for the number of places in which two sketches differ."""
    return " + ".join(f"bit_count(({a}[{i}] ^ {b}[{i}]) | ({a}[{i + _WORDS}] ^ {b}[{i + _WORDS}]))" for i in range(_WORDS))


def near_pairs(bands: DataFrame, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], classes: DataFrame) -> DataFrame:
    """Links (u, v) that connect every two keys of sufficient similarity that share a band or are a pair (u, v) of ``classes``.

    ``bands`` has key, size (of the set) and h, a row for each band, ``sketches``
    key and sketch; ``texts`` returns key and packed (the compressed text) for a
    table of keys.
    """

    def verified(pairs: DataFrame, name: str, made: DataFrame | None = None) -> DataFrame:
        pairs = written(pairs, f"{name}-candidates")
        if made is None:
            made = written(texts(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()), f"{name}-texts")
        a, b = made.select(F.col("key").alias("u"), F.col("packed").alias("a")), made.select(F.col("key").alias("v"), F.col("packed").alias("b"))
        return written(pairs.join(a, "u").join(b, "v").filter(_similar("a", "b")).select("u", "v"), f"{name}-near")

    alike = verified(classes, "classes")
    common = written(bands.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    # Spark's size estimate leaves out that a text has many bands, so that it would broadcast them
    shared = written(bands.join(common.hint("merge"), "h"), "shared")
    # the text that shares most bands with others is likely to be what a cloud of near copies lies around
    central = shared.groupBy("key").agg(F.sum("n").alias("score"))
    leaders = shared.join(central, "key").groupBy("h").agg(F.max(F.struct("score", "key", "size")).alias("first"))
    led = shared.join(leaders, "h").select("h", "key", "size", F.col("first.key").alias("leader"), F.col("first.size").alias("other"))
    stars = led.filter("key <> leader").filter(_FITS).select(F.least("key", "leader").alias("u"), F.greatest("key", "leader").alias("v")).distinct()
    for end, name in (("u", "a"), ("v", "b")):
        stars = stars.join(sketches.select(F.col("key").alias(end), F.col("sketch").alias(name)), end)
    near = verified(stars.filter(f"{_apart('a', 'b')} <= {APART}").select("u", "v"), "stars").unionAll(alike)
    parts = connected_components(near)
    open_ = shared.filter("n > 2").select("h", "key", "size").join(parts, F.col("key") == parts.node, "left")
    open_ = open_.select("h", "key", "size", F.coalesce("component", "key").alias("component"))
    split = open_.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("h")
    open_ = written(open_.join(split, "h").join(sketches, "key"), "open")
    made = written(texts(open_.select("key").distinct()).withColumn("fine", _fine("packed")), "open-texts")
    open_ = open_.join(made.select("key", "fine"), "key")
    other = open_.select("h", F.col("key").alias("v"), F.col("size").alias("other"), F.col("component").alias("apart"), F.col("sketch").alias("b"), F.col("fine").alias("c"))
    rest = open_.join(other, "h").filter("component < apart").filter(_FITS)
    rest = rest.filter(f"{_apart('sketch', 'b')} <= {APART}").filter(f"{_fine_apart('fine', 'c')} <= {FINE_APART}")
    return near.unionAll(verified(rest.select(F.least("key", "v").alias("u"), F.greatest("key", "v").alias("v")).distinct(), "rest", made))


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in texts])


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    sets: dict[bytes, np.ndarray] = {}

    def of(packed: bytes) -> np.ndarray:
        # the texts of a batch recur; those of a few rows are kept at once
        if packed not in sets:
            if len(sets) > 500:
                sets.clear()
            sets[packed] = shingles_of(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
        return sets[packed]

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        same = len(np.intersect1d(x, y, assume_unique=True))
        return same * UNDER >= (len(x) + len(y) - same) * OVER

    return pd.Series([similar(of(x), of(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


_LONGS = T.ArrayType(T.LongType())


@F.pandas_udf(_LONGS)
def _fine(packed: pd.Series) -> pd.Series:
    return pd.Series([fine_sketch_of(shingles_of(zlib.decompress(p).decode("utf-8", "surrogatepass"))) for p in packed])


@F.pandas_udf(T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", _LONGS), T.StructField("sketch", _LONGS)]))
def _signature(texts: pd.Series) -> pd.DataFrame:
    keys, sizes, bands, sketches = [], [], [], []
    for t in texts:
        found = shingles_of(t)
        least = minima_of(found)
        keys.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
        sizes.append(len(found))
        # texts without words have one key, so that they need no band
        bands.append(bands_of(least) if len(found) else np.zeros(0, np.int64))
        sketches.append(sketch_of(least))
    return pd.DataFrame({"key": np.array(keys, np.int64), "size": np.array(sizes, np.int32), "bands": bands, "sketch": sketches})


def _classes(docs: DataFrame, own: DataFrame, text_col: str) -> DataFrame:
    """Pairs of keys (u, v): every text of a SimHash class with the one that names the class, if their sets are of fitting size.

    Texts stand for rows here, so that ids may be null or repeated.
    """
    found = simhash.near_duplicates(docs.select(F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text")), "own", "text")
    found = found.filter("own <> component_id").select("own", "component_id").distinct()
    keys = own.groupBy("own").agg(F.first("key").alias("key"), F.first("size").alias("size"))
    named = keys.select(F.col("own").alias("component_id"), F.col("key").alias("name"), F.col("size").alias("other"))
    pairs = found.join(keys, "own").join(named, "component_id").filter("key <> name").filter(_FITS)
    return pairs.select(F.least("key", "name").alias("u"), F.greatest("key", "name").alias("v")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of texts whose 5-word shingles have a Jaccard similarity of 0.8: see :func:`simhash.keep_first`.

    Texts without words are copies of each other; rows without a similar one
    stay.  An empty table gives an empty one; other columns are left alone.
    """
    spark, at = docs.sparkSession, {name: new_path(docs.sparkSession, name) for name in ("signatures", "keys")}
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), _signature(F.col(text_col)).alias("s"))
    own = written(own.select("id", "own", "s.*", F.monotonically_increasing_id().alias("row")), "signatures", at["signatures"])
    one = written(own.groupBy("key").agg(F.min_by("own", "row").alias("own"), F.min("row").alias("row")), "keys", at["keys"])

    def texts(used: DataFrame) -> DataFrame:
        found = docs.select(F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text")).join(one.join(used, "key").select("own", "key"), "own")
        return found.select("key", _packed("text").alias("packed")).groupBy("key").agg(F.first("packed").alias("packed"))

    distinct = own.join(one.select("row"), "row", "left_semi")
    near = near_pairs(distinct.select("key", "size", F.explode("bands").alias("h")), distinct.select("key", "sketch"), texts, _classes(docs, own, text_col))
    parts = connected_components(near)
    named = own.select("id", "own", "key").join(parts, F.col("key") == parts.node, "left")
    out = simhash.keep_first(docs, named.select("id", "own", F.coalesce("component", "key").alias("component")), id_col, text_col)
    for path in at.values():
        remove(spark, path)
    return out
