"""Communities by label propagation and modularity merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agorasift.operators.durable import durable


def _both_ways(edges: DataFrame) -> DataFrame:
    """Undirected weights as two rows per edge, without loops."""
    pairs = edges.where(F.col("src") != F.col("dst")).groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(F.sum("weight").cast("double").alias("weight"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def label_propagation(edges: DataFrame) -> DataFrame:
    """``(node, community)``: each node takes the heaviest label around it.

    Ties go to the smaller label, and only half of the nodes (by hash,
    alternating) move in a round, which stops neighbours from swapping labels
    for ever.  Rounds go on until neither half has anything to change.
    """
    links = durable(_both_ways(edges))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst"))).distinct()
    labels = durable(nodes.withColumn("community", F.col("node")))
    unmoved = turn = 0
    while unmoved < 2:
        heard = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(
            F.sum("weight").alias("weight"))
        best = heard.groupBy(F.col("src").alias("node")).agg(
            F.max_by("community", F.struct("weight", -F.col("community"))).alias("heard"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        after = durable(labels.join(best, "node", "left").select(
            "node", F.when(moves, F.coalesce("heard", "community")).otherwise(F.col("community")).alias("community")))
        unmoved = unmoved + 1 if after.join(labels, ["node", "community"], "left_anti").isEmpty() else 0
        labels, turn = after, turn + 1
    return labels


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Per community: inner weight, degree and its share of the modularity."""
    links = _both_ways(edges)
    total = links.agg(F.sum("weight")).first()[0] or 1.0  # twice the edge weight
    tagged = links.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(
        labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    sums = tagged.groupBy(F.col("a").alias("community")).agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("degree"))
    share = F.col("inner") / total - resolution * (F.col("degree") / total) * (F.col("degree") / total)
    return sums.withColumn("modularity", share)


def _merge_once(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """Join pairs of communities that gain most modularity from each other."""
    links = _both_ways(edges)
    total = links.agg(F.sum("weight")).first()[0] or 1.0
    tagged = durable(
        links.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src")
        .join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
        .groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    )
    degrees = tagged.groupBy("a").agg(F.sum("weight").alias("degree"))
    gains = (
        tagged.where(F.col("a") != F.col("b")).join(degrees.withColumnRenamed("degree", "da"), "a")
        .join(degrees.select(F.col("a").alias("b"), F.col("degree").alias("db")), "b")
        .withColumn("gain", F.col("weight") / total - F.col("da") * F.col("db") / (total * total))
        .where(F.col("gain") > 1e-12)
    )
    choice = durable(gains.groupBy("a").agg(F.max_by("b", F.struct("gain", -F.col("b"))).alias("b")))
    # both must choose each other; the smaller name stays
    mutual = choice.join(choice.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    renamed = mutual.where(F.col("a") > F.col("b")).select(F.col("a").alias("community"), F.col("b").alias("_to"))
    if renamed.isEmpty():
        return labels, False
    merged = labels.join(renamed, "community", "left").select("node", F.coalesce("_to", "community").alias("community"))
    return durable(merged), True


def communities(edges: DataFrame) -> DataFrame:
    """Hierarchy of communities: ``(node, level, community)``.

    Level 0 comes from label propagation (Raghavan et al., 2007); each next
    level merges pairs of communities while modularity grows (after Blondel et
    al., 2008), until no pair gains.  Each level has fewer communities.
    """
    labels, level, changed = label_propagation(edges), 0, True
    result = labels.withColumn("level", F.lit(0))
    while changed:
        labels, changed = _merge_once(edges, labels)
        level += 1
        if changed:
            result = result.unionByName(labels.withColumn("level", F.lit(level)))
    return result
