"""Connected components of an edge table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    In each round every node moves to its smallest neighbour and on to that one's, and the edges
    between different places go on. A node with many edges is spread by partial minima. Self-loops
    and repeated edges change nothing; no edges give no rows. Each round's tables are written and read again, so that their
    sizes are the files': a checkpoint keeps the estimate of its plan, and the product of the
    sizes of self-joins squares with every step until planning stalls.
    """
    edges = edges.select(F.col("a").alias("a"), F.col("b").alias("b"))
    left = materialise(edges.where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    members = materialise(nodes.withColumn("component", F.col("node")))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to")))
        for _ in range(2):
            onward = step.select(F.col("a").alias("to"), F.col("to").alias("further"))
            step = materialise(step.join(onward, "to").select("a", F.col("further").alias("to")))
        move = step.select(F.col("a").alias("component"), "to")
        members = materialise(members.join(move, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        end = step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        left = left.join(step, "a").join(end, "b").where("to <> tb")
        left = materialise(left.select(F.col("to").alias("a"), F.col("tb").alias("b")).distinct())
    return members
