"""URL filters: host rules, and association rules over URL tokens mined with FP-growth.

Transactions are the distinct tokens of labelled URLs and, for a bad page, the
item ``label=bad``.  Tokens that occur in exactly the same URLs count as one, so
that tokens which always stand together do not multiply itemsets; rules are
written out with each of them afterwards.  Rules whose
consequent is the label are kept if they reach a support and a confidence, the
latter by the lower end of its 95 % interval (Wilson's), which a rule of few rows
can't reach.  One whose tokens include those of a kept rule says nothing more
and goes.  The rules are written before they are joined, so that Spark sees how
small they are: an inverted index under their rarest token meets the tokens of
all URLs, and candidates are verified by containment.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import new_path, remove, written

BAD = "label=bad"
#: Of a 95 % interval.
Z = 1.96

#: (verdict, host, path), written as host/path.
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules or HOST_RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, path segments with digits as 0, query keys, fragment mark."""
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    labels = F.transform(F.split(host(url), r"\."), lambda t: F.concat(F.lit("host:"), t))
    steps = F.transform(F.split(path(url), "/"), lambda t: F.concat(F.lit("path:"), F.regexp_replace(t, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(low, F.lit("[?&]([^=&#]+)"), 1), lambda t: F.concat(F.lit("query:"), t))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(low, "^([a-z]+)://", 1)))
    mark = F.when(F.instr(low, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(scheme, labels, steps, keys, mark)), lambda t: ~t.endswith(":"))


def _twins(labelled: DataFrame) -> DataFrame:
    """token and first: the first in order of the tokens that occur in exactly the same rows; rows has a number for each token."""
    rows = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("token"))
    # the rows of a token as two sums of hashes: 128 bits
    marks = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)")).alias(f"mark{seed}") for seed in (1, 2)]
    per_token = rows.groupBy("token").agg(F.count("*").alias("rows"), *marks)
    firsts = per_token.groupBy("rows", "mark1", "mark2").agg(F.min("token").alias("first"))
    return per_token.join(firsts, ["rows", "mark1", "mark2"]).select("token", "first", "rows")


def lower_confidence(confidence: Column, rows: Column) -> Column:
    """The lower end of Wilson's interval of a share seen in so many rows."""
    middle = confidence + Z * Z / (2 * rows)
    return (middle - Z * F.sqrt(confidence * (1 - confidence) / rows + Z * Z / (4 * rows * rows))) / (1 + Z * Z / rows)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """Rules of columns tokens, confidence, support and rarest (the token with the fewest labelled rows) from rows of tokens and bad.

    A rule of n rows, all bad, has a confidence of at least ``min_confidence``
    only if n / (n + z^2) does, so itemsets of fewer rows are not mined.  Rules
    whose tokens include another rule's are left out.  Rows with null ``bad`` are not used; without any bad row there are no rules.
    """
    spark, folder = labelled.sparkSession, new_path(labelled.sparkSession, "url-labels")
    known = written(labelled.filter("bad IS NOT NULL").select("tokens", "bad"), "url-labels", folder)
    twins = written(_twins(known), "url-tokens")
    total = known.count()
    row = known.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode_outer("tokens").alias("token"))
    items = row.join(twins, "token", "left").groupBy("row", "bad").agg(F.collect_set("first").alias("items"))
    items = items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    least = max(min_support, min(1.0, Z * Z * min_confidence / (1 - min_confidence) / max(1, total)))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = rules.filter(lower_confidence(F.col("confidence"), F.col("support") * total / F.col("confidence")) >= min_confidence)
    rules = without_longer(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    # a rule stands for those with twins of its tokens, too; twins are tokens of one URL, so few
    classes = twins.groupBy("first").agg(F.collect_list("token").alias("twins"), F.first("rows").alias("rows"))
    parts = rules.select("tokens", F.explode("tokens").alias("first")).join(classes, "first").groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("rows", "first", "twins"))).alias("parts"))
    choices = F.aggregate("parts", F.array(F.array().cast("array<string>")), lambda made, part: F.flatten(F.transform(made, lambda m: F.transform(part["twins"], lambda t: F.array_append(m, t)))))
    rules = rules.join(parts, "tokens").select(F.explode(choices).alias("tokens"), "confidence", "support")
    # the first token is of the class with the fewest rows
    out = written(rules.select(F.array_sort("tokens").alias("tokens"), "confidence", "support", F.col("tokens")[0].alias("rarest")), "url-rules")
    remove(spark, folder)
    return out


def without_longer(rules: DataFrame) -> DataFrame:
    """Rules whose tokens include no other rule's; pairs meet on a shared token."""
    one = rules.select("tokens", F.explode("tokens").alias("t"))
    two = rules.select(F.col("tokens").alias("shorter"), F.col("tokens")[0].alias("t"))
    longer = one.join(two, "t").filter((F.size("shorter") < F.size("tokens")) & (F.size(F.array_except("shorter", "tokens")) == 0))
    return rules.join(longer.select("tokens").distinct(), "tokens", "left_anti")


def filter_urls(pages: DataFrame, labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """pages with host, path, rule, mined (tokens of the mined rule of highest confidence) and verdict.

    ``labelled`` has columns url and bad.  The longest host rule decides; else a
    mined rule blocks; else the url is allowed.  A null url has no tokens and
    is allowed; a long one is taken whole.  Rows stay as they are; columns of
    pages with the names of new ones are replaced, and one named _rule is
    dropped.  Of rules with the same confidence the one with the largest tokens
    is named.  An empty table gives an empty result.
    """
    rules = without_longer(mine_rules(labelled.select(tokens(F.col("url")).alias("tokens"), "bad"), min_support, min_confidence))
    index = written(rules.select(F.col("tokens").alias("mined"), "confidence", F.col("rarest").alias("t")), "url-index")
    out = pages.drop("mined", "_rule")
    if index.isEmpty():
        out = out.withColumn("mined", F.lit(None).cast("array<string>"))
    else:
        # only tokens that meet a rule move
        postings = pages.filter("url IS NOT NULL").select("url", tokens(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("t"))
        hits = postings.join(index, "t").filter(F.size(F.array_except("mined", "tokens")) == 0)
        best = hits.groupBy("url").agg(F.max_by("mined", F.struct("confidence", "mined")).alias("mined"))
        out = out.join(best, "url", "left")
    out = out.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    out = out.withColumn("_rule", host_rule(F.col("host"), F.col("path")))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}).drop("_rule")
