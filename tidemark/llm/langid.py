"""Language identification by error-correcting output codes.

Every language owns a codeword.  For each bit a binary n-gram classifier (naive
Bayes log-odds, languages weighted alike within each side of the bit) predicts
the bit of a text's language; decoding picks the codeword with the least loss
over the bits, each bit weighted by how well its classifier did in training.
Short code distance between the best two codewords flags ambiguity.

Counting n-grams is one map over the training rows followed by a sum over
(language, bucket); what reaches the driver is languages x buckets, both fixed
by parameters.  Prediction is a map with no shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import sampled

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
BLOCK = 1 << 18
UNKNOWN = "und"
_LETTERS = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))
PREDICTION = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codes(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of the words of a text, a block at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    data = b" " + b" ".join(data.split()) + b" "
    for at in range(0, len(data), BLOCK):
        block = np.frombuffer(data[at : at + BLOCK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        gram, out = block.copy(), []
        for n in range(2, max(ORDERS) + 1):
            size = min(len(data) - n + 1 - at, BLOCK)
            if size <= 0:
                break
            gram = gram[:size]
            gram *= np.uint32(0x01000193)
            gram ^= block[n - 1 : n - 1 + size]
            if n in ORDERS:
                mixed = gram + np.uint32(n)
                mixed *= np.uint32(0x9E3779B1)
                mixed >>= np.uint32(32 - BUCKET_BITS)
                out.append(mixed)
        if out:
            yield np.concatenate(out).astype(np.intp)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: every split of up to 6 languages, else seeded splits with the best least distance of 50 tries."""
    if n <= 6:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=n - 1)]
        return np.array([s for s in splits if -1 in s] or [(1,) * n], np.int8).T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)

    def distance(m):
        apart = (bits - m.astype(int) @ m.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        return apart.min()

    tries = []
    for _ in range(50):
        m = np.array([rng.permutation(np.arange(n) % 2) * 2 - 1 for _ in range(bits)], np.int8).T
        tries.append((distance(m), len(tries), m))
    return max(tries, key=lambda x: (x[0], -x[1]))[2]


@dataclass(frozen=True)
class Model:
    """Codewords (languages x bits), log-odds (buckets x bits, padded with zeros), the mean margin of each bit and its weight."""

    langs: tuple[str, ...]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        bits = len(self.scale)
        total, n = np.zeros(bits), 0
        for block in codes(text):
            total += (np.ones(len(block), np.float32) @ self.odds.take(block, axis=0))[:bits]
            n += len(block)
        return total / max(n, 1) / self.scale

    def predict(self, text: str | None, ambiguous_below: float) -> tuple[str, float, bool]:
        if not has_letter(text):
            return UNKNOWN, 0.0, False
        margins = np.clip(self.margins(text), -4, 4)
        loss = (np.exp(-self.code * margins) * self.weight).sum(axis=1) / self.weight.sum()
        best = int(np.argmin(loss))
        share = np.exp(-4 * (loss - loss[best]))
        score = float(1 / share.sum())
        return self.langs[best], score, score < ambiguous_below


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            counts = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for block in codes(text):
                counts += np.bincount(block, minlength=BUCKETS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})


def _odds(counts: np.ndarray, code: np.ndarray, smooth: float) -> np.ndarray:
    p = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
    bits = [np.log(p[b > 0].mean(axis=0)) - np.log(p[b < 0].mean(axis=0)) if (b < 0).any() else np.ones(p.shape[1]) for b in code.T]
    return np.array(bits, np.float32).T


def train(rows: DataFrame, max_docs_per_lang: int = 4000, max_langs: int = 256, smooth: float = 0.5, seed: int = 7, id_col: str = "doc_id") -> Model:
    """Fit on columns text and lang; ids only choose the sample.

    Rows with a null or letterless text or a null language are not used.  The
    fit takes a bounded sample: about ``max_docs_per_lang`` whole texts of a
    language, picked by a hash of id and text, and the ``max_langs`` most frequent
    languages.  Raises ValueError if there is no usable row.
    """
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col(id_col).alias("id"), "text", "lang")
    sizes = rows.filter(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        raise ValueError("no labelled text to learn from")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs_per_lang / r["count"]))])
    picked = usable.filter(sampled(share[F.col("lang")], seed, F.col("id"), F.col("text")))
    sums = picked.select("text", "lang").mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(sums["lang"].unique()))
    if not langs:
        raise ValueError("no labelled text to learn from")
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in sums["lang"]], sums["bucket"]] = sums["n"]
    code = codewords(len(langs), seed)
    odds = _odds(counts, code, smooth)
    # margins of each language's own n-gram distribution give the scale and the weight of a bit
    shares = counts / counts.sum(axis=1, keepdims=True)
    own = (shares @ odds) * code
    scale = np.maximum(np.abs(own).mean(axis=0), 1e-6)
    weight = np.clip(own.min(axis=0) / scale, 0.05, 1.0)
    padded = np.hstack([odds, np.zeros((BUCKETS, -odds.shape[1] % 8), np.float32)])  # rows of 32 bytes are gathered faster
    return Model(langs, code, padded, scale, weight)


def predict(text: Column, model: Model, ambiguous_below: float = 0.5) -> Column:
    """Struct of lang (``und`` for null or letterless text), score (0 to 1) and ambiguous."""
    model_langs, parts = model.langs, (model.code, model.odds, model.scale, model.weight)

    @F.pandas_udf(PREDICTION)
    def ecoc(texts: pd.Series) -> pd.DataFrame:
        m = Model(model_langs, *parts)
        return pd.DataFrame([m.predict(t, ambiguous_below) for t in texts], columns=["lang", "score", "ambiguous"])

    # else a filter on the prediction would have it made twice
    return ecoc.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """docs with columns held_out, lang_pred, score and ambiguous.

    Learns from ``text`` and ``lang`` of documents that are not held out; only
    ``text`` enters a prediction.  Where nothing can be learned every text is
    ``und`` with score 0.  Rows are kept as they are; columns of ``docs`` with
    the name of a new column are replaced.
    """
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    try:
        model = train(marked.filter(~F.col("held_out")), **options)
    except ValueError:
        return marked.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(False)})
    out = marked.withColumn("_p", predict(F.col("text"), model))
    return out.withColumns({"lang_pred": F.col("_p.lang"), "score": F.col("_p.score"), "ambiguous": F.col("_p.ambiguous")}).drop("_p")
