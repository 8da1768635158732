"""Connected components over links, in rounds of star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agorasift.llm.storage import discard, stored, stored_at


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Each round runs a large and a small star: every node hangs its larger
    neighbours, then its smaller ones, on the smallest it knows.  Rounds follow
    the logarithm of the path length, not the length.  The smallest neighbours
    are written before they are joined, so both sides of each join are plain
    exchanges that adaptive execution can split at a hub.  Null nodes and links
    of a node to itself are left out; no links give no rows.
    """
    spark = links.sparkSession
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path = stored_at(ordered.distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = edges.union(edges.select("v", "u"))
        nearest, nearest_path = stored_at(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "nearest")
        larger = both.join(nearest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = stored_at(larger.distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        edges, path = stored_at(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (old, nearest_path, large_path):
            discard(spark, done)
