"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import discard, saved


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of edges(src, dst): component is the least node that it is linked with.

    Each round only joins the edges with one minimum per node (a partial aggregate, so a node with very many
    edges is summed up before it is moved; the join back is one that Spark can split). Rounds grow with the
    logarithm of the longest chain. Null ends and loops add no edge; a node seen only in loops is not returned.
    Empty edges give an empty result.
    """
    # as (high, low)
    pairs = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    now = saved(pairs, "cc")
    for _ in range(most_rounds):
        # Large star: link every larger neighbour of a node to the node's least neighbour.
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct()
        # Small star: link the smaller neighbours of a node to the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        step = large.join(low, "hi")
        small = step.where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).unionByName(low.select("hi", F.col("low").alias("lo"))).distinct()
        after = saved(small, "cc")
        # Settled when the edges are stars around nodes that are nobody's member: no low end is also a high end.
        settled = after.select("lo").distinct().join(after.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").isEmpty()
        once = after.groupBy("hi").count().where("count > 1").isEmpty()
        discard(now)
        now = after
        if settled and once:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
