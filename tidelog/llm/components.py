"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import drop, settle


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node that it reaches) of every node of the links.

    Large-star and small-star steps alternate until the edges stay as they are; each step is a minimum per node (combined before the
    shuffle) and a join, and its edges are written to the shared folder.
    """
    edges = settle(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "components-edges")
    for _ in range(rounds):
        if _stars(edges):
            return edges.groupBy("hi").agg(F.min("lo").alias("comp")).select(F.col("hi").alias("node"), "comp").unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("m", F.explode(F.array("hi", "lo")).alias("v")).where("v > m")
        old, edges = edges, settle(small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "components-edges")
        drop(old)
    raise RuntimeError(f"components still change after {rounds} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a component's smallest node: no node has two, and none is at both ends."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("hi"), F.lit(0).alias("lo")).unionAll(edges.select(F.col("lo"), F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).where("hi > 1 or (hi > 0 and lo > 0)")
    return bad.isEmpty()
