"""Connected components of a link table, as alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links(a, b)`; component is the smallest node reachable.

    Each round is two grouped minima and two joins on the node, so a hub (a node with a third
    of all links) is pre-aggregated before the shuffle and its join can be split. The number
    of rounds grows with the logarithm of the longest path. A round that does not converge
    within `max_rounds` raises; nothing is cut off. Null nodes and self links are ignored.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(
            edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select(
            "n", F.least("n", "least").alias("least"))
        large = both.where("m > n").join(least, "n").select(
            F.col("m").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        large = stored(large, "links")
        # small star: a node's smaller neighbours and itself are linked to the smallest of them
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(root, "hi").select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo")),
                              F.struct(F.col("hi"), F.col("root").alias("lo")))).alias("e")
        ).select("e.*").where("hi <> lo").distinct()
        edges = stored(small, "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
                          F.count_distinct("hi").alias("heads")).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.union(roots)
