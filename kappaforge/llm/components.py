"""Connected components of a link table, by alternating large and small stars.

Every round is a pre-aggregated minimum and a join; no node's links meet in
one task, and the result of a round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.llm.store import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Links every neighbour to the smallest node of its centre's neighbourhood."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
        # a centre that is itself not the smallest keeps a link to it
        return out.unionByName(low.where("low < a").select("a", F.col("low").alias("b"))).where("a > b").distinct()
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    out = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.unionByName(low.select("a", F.col("low").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; label is the smallest node of its component.

    ``links`` has columns a and b of one orderable type; nulls and self links
    count for nothing, repeated links once. No links give an empty result.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        before, edges = edges, written(_star(_star(edges, True), False), "stars")
        dropped(before)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
