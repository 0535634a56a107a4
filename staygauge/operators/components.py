"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygauge.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges to (node, component): the smallest node of each connected part, for nodes that have an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every node's larger neighbours, then its smaller
    ones, are hung below the smallest node in sight. Chains shrink by a constant factor per round, so long ones need
    few rounds. Each step is a partial minimum and an equi-join; neighbours are never collected, so a hub node costs
    no more memory than any other. Each round is settled, which keeps the plan short and survives lost executors.
    """
    def hang(pairs: DataFrame) -> DataFrame:
        return pairs.filter("u != v").distinct()

    links = settle(hang(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hang(both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(hang(small.unionByName(lowest.select("u", F.col("m").alias("v")))), "links")
        # Done when only stars are left: no centre hangs below another node, and every node hangs below one.
        nested = links.join(links.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x"))
        split = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(1).alias("x"))
        if nested.unionByName(split).isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
