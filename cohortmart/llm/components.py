"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmart.llm.common import discard, last_stored, stored


def fewer_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: edges that join the same nodes as those given, about one for each node.

    The partners of a node are joined to the smallest of them instead of to the node, and where many nodes share their
    partners those edges are the same ones. A node's partners are gathered: each node has few, whatever its group's size.
    """
    near = edges.where(F.col(a) != F.col(b)).groupBy(F.col(a).alias("__node")).agg(F.array_sort(F.collect_set(b)).alias("__near"))
    least = F.least("__node", F.get("__near", F.lit(0)))
    pairs = near.select(F.explode(F.concat(F.array("__node"), "__near")).alias("a"), least.alias("b"))
    return pairs.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge to another node.

    A round joins each node's smallest neighbour back to its edges; rows never exceed the edges, and a node with very
    many neighbours is counted before it is shuffled. The number of rounds grows with the logarithm of the graph.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stored(e, "components")
    path = last_stored()
    mark = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    before = mark(e)
    while before["n"]:
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        low = both.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("node", "m"))
        large = e.join(low, e["v"] == low["node"]).select("u", F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = mark(e)
        # A round needs the one before only while it is written.
        discard(edges.sparkSession, [path])
        path = last_stored()
        if now == before:  # stars already: a round changes nothing
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
