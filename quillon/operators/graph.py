"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components by the smallest label. Alternating stars: every node hands its larger
    neighbours, then its smaller ones, over to the smallest of all, until each component is one star around its smallest
    label. The rounds grow with the logarithm of the nodes, not with the diameter. The graph stays distributed, and
    every round is a table read back: a checkpoint would keep the constraints of its plan, which double every round."""
    links = stage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")))
    nodes = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).where("node is not null").distinct()
    down = stage(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    # a star's leaves have one edge each, and its centre none downwards
    while down.groupBy("x").count().where("count > 1").limit(1).count() or down.join(down.select(F.col("y").alias("x")), "x", "left_semi").limit(1).count():
        both = down.unionByName(down.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low"))
        larger = stage(both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct())
        low = larger.groupBy("x").agg(F.min("y").alias("low"))
        smaller = larger.join(low, "x").where("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        down = stage(smaller.unionByName(low.select("x", F.col("low").alias("y"))).distinct())
    return nodes.join(down, F.col("node") == F.col("x"), "left").select("node", F.coalesce("y", "node").alias("root"))
