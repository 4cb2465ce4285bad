"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node in ``edges`` (a, b).

    Alternating large-star and small-star steps: each node's links are turned to the least node
    near it until nothing changes, a number of rounds that grows with the logarithm of the
    longest path. Each round is a minimum by node, summed before the shuffle, and a join.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    links, seen = cut_lineage(links, small=True), None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(
            F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u != v").distinct()
        links = cut_lineage(small, small=True)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
