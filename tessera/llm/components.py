"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges; it turns paths into
stars in a number of rounds that grows with the logarithm of the size.  Edges
stay distributed; only whether they are stars yet reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import drop_staged, staged


def _stars(edges: DataFrame) -> bool:
    """Whether one edge at most leaves each node, and none leaves a node that another leads to."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not per.filter("out > 1 or (out = 1 and into = 1)").limit(1).count()


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with an edge to another node, the least node it reaches."""
    high, low = F.greatest(a, b), F.least(a, b)
    now = staged(edges.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(now):
        before, now = now, staged(_small(_large(now)), "edges")
        drop_staged(before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
