"""Mixing sources to target weights over a domain - language - source tree.

Budgets go down the tree: a node's tokens are shared among its children in
proportion to their weights, no child gets more than its subtree can give
(tokens x ``max_epochs``), and what a short child leaves goes to its siblings;
only what a whole subtree can't use reaches its parent's siblings.  As a
subtree's capacity bounds its budget before the budget is shared out, siblings
come before ancestors at every level.

A leaf with a budget of e epochs and r tokens takes every document e times and,
of one more epoch, the prefix of a seeded order whose tokens fit in r.  The cut
is found without sorting a leaf: documents fall into 4,096 ranges of the order,
the sums of ranges say which range holds the cut, and only that range is summed
document by document.  A leaf with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import written
from tidemark.llm.text import SOLID, word_count

LEVELS = ("domain", "lang", "source")


def _share_out(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``budget`` to nodes, which have the parent's budget in ``given``, and ``weight`` and ``capacity``.

    With children in ascending capacity per weight, the first k get their
    capacity and the rest share what is left by weight; k is where that share
    first fits.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parents).orderBy(F.col("_ratio"), F.col(child))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("_ratio", ratio)
    out = out.withColumns({"_used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_rest": F.sum("weight").over(onward)})
    # the water level if this child and all after it share by weight
    level = F.when(F.col("_rest") > 0, (F.col("given") - F.col("_used")) / F.col("_rest")).otherwise(F.lit(0.0))
    out = out.withColumn("_level", level)
    # children whose ratio is at most the level at their place are full and come first; from
    # the first other one on, that level falls, so its own is the highest of the rest
    short = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(*parents))
    out = out.withColumn("_share", short)
    budget = F.when(F.col("_share").isNull() | (F.col("_ratio") <= F.col("_level")), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.col("_share") + 1e-6))
    return out.withColumn("budget", F.least(F.col("capacity"), F.greatest(budget, F.lit(0))).cast("long")).drop("_ratio", "_used", "_rest", "_level", "_share")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: int | None, max_epochs: int, default: float = 1.0) -> DataFrame:
    """Budget of each leaf; ``leaves`` has one row for each domain, lang and source, with tokens.

    ``weights`` maps a level to weights of its values; others have ``default``.
    ``total`` of null means as many tokens as there are.
    """

    def weight(level: str) -> Column:
        known = weights.get(level) or {}
        if not known:
            return F.lit(float(default))
        table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, float(v))])
        return F.coalesce(table[F.col(level)], F.lit(float(default)))

    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    sums = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    given = sums.select((F.lit(total) if total is not None else F.col("t")).cast("long").alias("given"))
    above: list[str] = []
    for level in LEVELS:
        here = [*above, level]
        nodes = leaves.groupBy(*here).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(level))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))  # one row
        parts = above or [F.lit(0)]
        given = _share_out(nodes, parts, level).select(*here, F.col("budget").alias("given"))
        above = here
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS)).select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], total: int | None = None, max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Selected rows of docs with domain, tokens, epochs (whole epochs of the leaf) and copies (how often to repeat the row).

    Tokens are words.  A null source, language or domain is the leaf ''.  Texts
    without words cost nothing and are never selected.  Rows with
    one id are taken together or not at all.  Columns of docs named as the new
    ones are replaced, and ones named _key, _range, _end or _ and a level are dropped.
    """
    name = lambda c: F.coalesce(c, F.lit(""))
    # texts are cut into words once for the plan, and again only if ``tokens`` is asked for
    docs = docs.drop("epochs", "copies", "_key", "_range", "_end", *[f"{p}{c}" for c in LEVELS for p in ("_", "_p_")])
    rows = docs.withColumn("domain", domain).withColumn("tokens", word_count(F.col(text_col))).filter(F.col(text_col).rlike(SOLID))
    rows = rows.withColumns({"_domain": name(F.col("domain")), "_lang": name(F.col("lang")), "_source": name(F.col("source"))})
    small = rows.select(F.col(id_col).alias("_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "tokens")
    small = written(small, "mix-tokens")
    leaves = small.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, weights, total, max_epochs)
    plan = written(plan.select(*LEVELS, F.expr("cast(budget div tokens as int)").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")), "mix")

    def ordered(df: DataFrame, id_name: str) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.col(id_name)).cast("binary"))
        return df.withColumn("_key", key).withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))

    small = ordered(small.join(plan, list(LEVELS)), "_id")
    ranges = small.groupBy(*LEVELS, "rest", "_range").agg(F.sum("tokens").alias("t"))
    upto = ranges.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("_range")))
    cuts = upto.filter("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("_range", (F.col("upto") - F.col("t")).alias("before"))).alias("cut"))
    cuts = written(plan.join(cuts, list(LEVELS)), "mix-cuts")
    at_cut = small.join(cuts.select(*LEVELS, "cut"), list(LEVELS)).filter("_range = cut._range")
    upto_doc = F.col("cut.before") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "_range").orderBy("_key"))
    last = at_cut.withColumn("upto", upto_doc).filter("upto <= rest").groupBy(*LEVELS).agg(F.max("_key").alias("_last"))
    # a leaf's prefix ends with its last key; keys of earlier ranges sort before the cut range's own digits
    digits = F.lower(F.lpad(F.hex(F.col("cut._range").cast("long")), 3, "0"))
    ends = cuts.join(last, list(LEVELS), "left").select(*[F.col(c).alias(f"_p_{c}") for c in LEVELS], "epochs", F.coalesce("_last", digits).alias("_end"))
    ends = written(ends, "mix-ends")  # a row for each leaf

    out = rows.join(ends, [F.col(f"_{c}") == F.col(f"_p_{c}") for c in LEVELS])
    out = ordered(out, id_col)
    out = out.withColumn("copies", F.col("epochs") + F.when(F.col("_key") <= F.col("_end"), 1).otherwise(0)).filter("copies > 0")
    return out.drop("_key", "_range", "_end", *[f"{p}{c}" for c in LEVELS for p in ("_", "_p_")])
