"""Connected components by alternating large-star and small-star steps.

Every step is one minimum per node (combined before the shuffle) and one join;
a hub's edges are split by the skew join. Nothing of the graph reaches the driver
but an edge count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b) that is not its component's least id."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        found = _star(large)
        small = (found.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = cut(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = new
