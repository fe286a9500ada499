"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of every benchmark item (an
item of fewer words is one window).  Patterns of one length share a table: a
shift table over blocks of two adjacent words says how far the scan may jump, a
suffix bucket lists the patterns that end in the block at hand together with
their first block, and whatever passes both is compared word by word.  In
ordinary text nearly every block is unknown, so the scan looks at one word in
twelve.

The scan is a map over documents with no shuffle, so neither a hot source nor a
passage that a third of all documents share makes one task larger.  The
benchmark is what is sent to the tasks, so its size is measured first; beyond
``max_bytes`` it is cut into shards that are searched one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import written

WINDOW = 13
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and anything beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Searcher:
    """Shift tables and suffix buckets for patterns of equal length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends = defaultdict(list)
        for pattern, items in patterns.items():
            for at in range(self.block, length + 1):
                key = pattern[at - self.block : at]
                self.shift[key] = min(self.shift.get(key, self.jump), length - at)
            self.ends[pattern[-self.block :]].append((pattern[: self.block], pattern, items))

    def find(self, words: list[bytes]):
        """(start, items) of every occurrence, in order."""
        length, jump, shift = self.length, self.jump, self.shift.get
        at, n, one = length, len(words), self.block == 1
        while at <= n:
            key = (words[at - 1],) if one else (words[at - 2], words[at - 1])
            step = shift(key, jump)
            if step:
                at += step
                continue
            start = at - length
            first = tuple(words[start : start + self.block])
            for head, pattern, items in self.ends[key]:
                if head == first and tuple(words[start:at]) == pattern:
                    yield start, items
            at += 1


@lru_cache(maxsize=2)
def _searchers(items: tuple[tuple[str | None, str], ...], window: int) -> list[Searcher]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if length else 0):
            by_length[length][tuple(words[at : at + length])].add(item_id)
    return [Searcher(patterns, length) for length, patterns in sorted(by_length.items())]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans, flattened to start, end, start, end ..."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def search(text: str | None, searchers: list[Searcher]) -> tuple[int, list[int], set]:
    """Number of words, merged word spans inside occurrences, and the items that occur."""
    words, spans, items = words_of(text), [], set()
    for searcher in searchers:
        for start, found in searcher.find(words):
            spans.append((start, start + searcher.length))
            items |= found
    return len(words), _merge(spans), items


def _shards(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = -(-size // max_bytes) or 1
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) for k in range(shards)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = 32 << 20) -> DataFrame:
    """docs with one more column, contamination: n_words, n_hit, items, contaminated.

    ``n_hit`` counts document words inside any occurrence of a benchmark window,
    ``items`` are the distinct ids (as sorted strings) with an occurrence, and a
    document is contaminated if it has a hit word and hits are at least a
    twentieth of its words.  Null and wordless texts have no words and no hits;
    items without words have no window; an item with a null id counts in
    ``n_hit`` and is not listed.  Rows are kept as they are, repeated ones too,
    and a column called contamination is replaced.
    """
    found = "_found"
    out = docs.withColumn(found, F.lit(None).cast(FOUND))
    shards = _shards(benchmark, item_col, item_text_col, max_bytes)
    for k, shard in enumerate(shards):
        items = tuple(sorted((tuple(r) for r in shard.distinct().collect()), key=str))  # at most about max_bytes
        out = out.withColumn(found, _search(F.col(text_col), F.col(f"{found}.spans"), F.col(f"{found}.items"), items, window))
        if k + 1 < len(shards):
            out = written(out, "contamination")
    spans = F.col(f"{found}.spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.element_at(spans, i + 2) - F.element_at(spans, i + 1))
    n_hit = F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(hit)
    n_words = F.col(f"{found}.n_words")
    verdict = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), F.col(f"{found}.items").alias("items"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"))
    return out.withColumn("contamination", verdict).drop(found)


def _search(text: Column, spans: Column, listed: Column, items: tuple, window: int) -> Column:
    @F.pandas_udf(FOUND)
    def wu_manber(texts: pd.Series, before: pd.Series, listed_before: pd.Series) -> pd.DataFrame:
        searchers = _searchers(items, window)
        rows = []
        for text, old, old_items in zip(texts, before, listed_before, strict=True):
            n, new, hits = search(text, searchers)
            if old is not None and len(old):
                new = _merge([(a, b) for x in (list(old), new) for a, b in zip(x[::2], x[1::2], strict=True)])
            names = hits - {None} | set(() if old_items is None else old_items)
            rows.append((n, new, sorted(names)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return wu_manber(text, spans, listed)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
