"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; the component is its smallest node.

    Each round joins every node's neighbours to the smallest of them; rounds grow with the logarithm of the
    longest chain. A node with many links is never gathered: its minimum is pre-aggregated and joined back.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = steps.write(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = steps.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = steps.write(small.distinct())
        # Done when every node has one edge down and none ends where another begins: a star for each component.
        roles = new.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(new.select("v", F.lit(0), F.lit(1)).toDF("u", "down", "up"))
        more = roles.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)")
        done = more.isEmpty()
        steps.drop(edges, large)
        edges = new
        if done:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
