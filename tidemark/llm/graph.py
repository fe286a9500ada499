"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.scratch import new_path, remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each linked node reaches: columns node, component.

    ``links`` has two integer columns, u and v; self-links and nulls are ignored.
    Nodes without a link, and the smallest node of a component itself, are not
    returned: they keep their own name.  Each round joins the links with
    one row per node, so a hub's links can be split over tasks, and is written
    to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    last = new_path(spark, "links")
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", last)
    mark = None
    for _ in range(max_rounds):
        path, seen = new_path(spark, "links"), Observation()
        moved = _small_star(_large_star(edges))
        # the write itself tells whether the links changed
        moved = moved.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = written(moved, "links", path)
        remove(spark, last)
        last, now = path, seen.get
        if now == mark or not now["n"]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
