"""Repeated runs of lines, found with a suffix array over line ids.

The corpus is a sequence of line ids (documents in order of id, a terminator
after each).  Suffixes are sorted by distributed prefix doubling: the rank of a
suffix by its first 2^(j+1) lines is the rank of the pair (rank by 2^j lines
here, rank by 2^j lines 2^j lines on).  Each round keeps only suffixes whose
rank is shared, as all others are settled, and ranks are numbered in sorted
order, so ranks of a round are the suffix array's LCP intervals of that depth.

A run counts if it has ``min_words`` words.  Whether a suffix starts such a run
depends on its interval at depth m, where m is the number of lines that reach
``min_words``; suffixes with a common m-line prefix have the same m, so that
interval is named by two overlapping ranks (of its first and its last 2^j
lines).  Windows that end at a line are treated alike, and the union of both
kinds is the union of all maximal repeated runs with ``min_words`` words.  The
first copy of every interval stays, the lines of later ones go.

Only DataFrame operations; a line has a word at least (blank lines take no part
and stay), so depth is bounded by ``min_words`` and rounds by its logarithm.
The number of a frequent line is an aggregate joined back, which can be split;
no window is partitioned by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import new_path, remove, written
from tidemark.llm.text import SOLID, word_count


def _key(*columns: Column) -> Column:
    """128 bits of hash: two XXH64 with different seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("other seed"), *columns).alias("b"))


def _named(rows: DataFrame, *by: str) -> DataFrame:
    """A new rank, ``longer``, for each value of ``by`` that two rows at least share, ascending in the order of ``by``."""
    shared = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(*by)
    return shared.orderBy(*by).withColumn("longer", F.monotonically_increasing_id())


def _numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with a word: id, doc, i (among such lines, from 0), line (among all, from 0), words, content."""
    texts = docs.select(F.col(id_col).alias("id"), _key(F.col(id_col), F.col(text_col)).alias("doc"), F.split(text_col, "\n").alias("lines"))
    solid = F.filter(F.transform("lines", lambda s, at: F.struct(at.alias("line"), s.alias("s"))), lambda x: x["s"].rlike(SOLID))
    rows = texts.select("id", "doc", F.posexplode(solid).alias("i", "x"))
    return rows.select("id", "doc", "i", F.col("x.line").alias("line"), word_count(F.col("x.s")).alias("words"), _key(F.col("x.s")).alias("content"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Lines of later copies of repeated runs: columns doc (key of id and text) and line (from 0 among all lines)."""
    spark, scratch = docs.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(new_path(spark, name))
        return written(df, name, scratch[-1])

    lines = _numbered_lines(docs, id_col, text_col)
    names = keep(_named(lines.select("content"), "content"), "line-names")
    # rows equal in id and text are one document
    found = keep(lines.join(names, "content").drop("content").withColumnRenamed("longer", "rank").dropDuplicates(["doc", "i"]), "lines")

    in_doc = Window.partitionBy("doc")
    level = found.select("doc", "i", "rank")
    levels, depth = [level.withColumn("j", F.lit(0))], 1
    while 2 * depth <= min_words:
        ahead = in_doc.orderBy("i").rangeBetween(depth, depth)
        pairs = keep(level.withColumn("next", F.max("rank").over(ahead)).filter("next IS NOT NULL"), "pairs")
        names = keep(_named(pairs, "rank", "next"), "pair-names")
        level = keep(pairs.join(names, ["rank", "next"]).select("doc", "i", F.col("longer").alias("rank")), "level")
        if level.isEmpty():
            break
        levels.append(level.withColumn("j", F.lit(len(levels))))
        depth *= 2
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)

    before = F.coalesce(F.sum("words").over(in_doc.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("x", before).withColumn("y", before + F.col("words"))
    onward, back = in_doc.orderBy("x").rangeBetween(0, min_words - 1), in_doc.orderBy("y").rangeBetween(-(min_words - 1), 0)
    span = lambda w, first, last: F.struct(first.alias("first"), last.alias("last"), F.sum("words").over(w).alias("words"), F.count("*").over(w).alias("n"))
    placed = placed.select("id", "doc", span(onward, F.col("i"), F.max("i").over(onward)).alias("on"), span(back, F.min("i").over(back), F.col("i")).alias("back"))
    spans = placed.select("id", "doc", F.explode(F.array("on", "back")).alias("w"))
    # a gap in i is a line that occurs once, so no run goes over it
    whole = spans.filter((F.col("w.words") >= min_words) & (F.col("w.n") == F.col("w.last") - F.col("w.first") + 1))
    windows = whole.select("id", "doc", "w.first", "w.last", F.col("w.n").cast("int").alias("m")).distinct()
    windows = windows.withColumn("j", F.length(F.bin("m")) - 1)
    windows = windows.withColumn("i2", F.expr("last + 1 - shiftleft(1, j)"))
    head = ranks.select("doc", "j", F.col("i").alias("first"), F.col("rank").alias("head"))
    tail = ranks.select("doc", "j", F.col("i").alias("i2"), F.col("rank").alias("tail"))
    intervals = keep(windows.join(head, ["doc", "j", "first"]).join(tail, ["doc", "j", "i2"]).select("id", "doc", "first", "last", "m", "head", "tail"), "windows")

    place = F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("doc").alias("doc"), F.col("first").alias("first"))
    firsts = intervals.groupBy("m", "head", "tail").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = intervals.join(firsts, ["m", "head", "tail"]).filter(place != F.col("kept"))
    # a copy that overlaps the first one in its own document loses only what lies beyond it
    start = F.when(F.col("doc") == F.col("kept.doc"), F.greatest(F.col("first"), F.col("kept.first") + F.col("m"))).otherwise(F.col("first"))
    gone = later.select("doc", F.explode(F.sequence(start, F.col("last"))).alias("i")).distinct()
    out = written(gone.join(found.select("doc", "i", "line"), ["doc", "i"]).select("doc", "line"), "repeated-lines")
    for path in scratch:
        remove(spark, path)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs without the lines of later copies of repeated runs, and with n_lines and deleted (sorted line numbers).

    A null text stays null with no lines; an empty text has one (blank) line.
    Blank lines are never deleted.  Rows equal in id and text are one document
    and get the same text.  Copies are ordered by id (nulls last), then by a
    hash of the text where ids are equal, then by line.  Columns of ``docs``
    named n_lines or deleted are replaced, and ones named _doc, _gone, _lines or
    _deleted are dropped.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words)
    per_doc = gone.groupBy(F.col("doc").alias("_gone")).agg(F.sort_array(F.collect_list("line")).alias("_deleted"))
    base = docs.drop("n_lines", "deleted", "_gone", "_deleted").withColumn("_doc", _key(F.col(id_col), F.col(text_col)))
    joined = base.join(per_doc, F.col("_doc") == F.col("_gone"), "left")
    # the text moves whole and is cut after the join; explode makes its lines a column, so they are cut once for each row
    joined = joined.withColumn("_lines", F.explode(F.array(F.split(text_col, "\n"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_deleted"))
    text = F.when(F.col("_deleted").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda at: F.element_at("_lines", at + 1)), "\n"))
    out = joined.withColumns(
        {
            text_col: text,
            "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")),
            "deleted": F.coalesce("_deleted", F.array().cast("array<int>")),
        }
    )
    return out.drop("_doc", "_gone", "_lines", "_deleted")
