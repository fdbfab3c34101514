"""Connected components of a graph given by links, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.shared import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for each node that has a link (a, b).

    Alternates two rewrites until nothing changes: every node links its larger neighbours to its smallest
    neighbour, then its smaller neighbours to the smallest. Each keeps the components and ends in stars;
    the number of rounds grows with the logarithm of the size. A node with many neighbours only ever needs
    their minimum, a partial aggregate, so it is not gathered anywhere.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, state = saved(edges.distinct()), None
    while True:
        # Links are a set, so their number and a sum of their hashes tell whether a round changed any.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        # Large star: over both directions, the larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours go to the smallest of them.
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
