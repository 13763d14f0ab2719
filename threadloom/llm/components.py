"""Connected components of a link table by alternating stars (Kiveris et al., 2014).

Each round joins every node with the smallest of its neighbours, first upwards (large star), then
downwards (small star), until no link changes. Links stay distributed; rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.workdir import Scratch


def components(scratch: Scratch, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node that links name; component is the smallest id reachable.

    `links` has two long columns a and b. Loops, repeated links and either direction are fine; rows
    with a null end are ignored. No links: an empty result.
    """
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = scratch.table(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join reads plain tables on both sides and Spark can split a star's centre
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = edges.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        before, edges = edges, scratch.table(small.where("u != v").distinct())
        scratch.drop(before, least)
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():  # every smaller end is a root
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
