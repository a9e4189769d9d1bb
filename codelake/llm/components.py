"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the larger (or not larger) neighbours of every node to the smallest node next to it.

    The smallest neighbour is a combinable aggregate, written and then joined back, so that a hub's edges are never
    gathered in one group and Spark can split the join where a hub's key is hot.
    """
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(near.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) of any comparable type -> (node, root): every node with an edge, and the smallest node of its component.

    Self edges and repeated edges are harmless; an empty table gives an empty table. Every round ends in a
    checkpoint, so the lineage stays one round long.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        now = cut(_star(_star(now, small=False), small=True))
        new = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
