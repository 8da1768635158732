"""Selection of accounts and posts for a human to label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from agorasift.operators.ranking import hash_order, pick_one, top_rows
from agorasift.sources.days import experiment_slice


def unlabeled_pool(users: DataFrame, predictions: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """Users with a prediction, no label, and no annotation yet."""
    open_ones = predictions.where(F.col("reported_label").isNull() & F.col("predicted_class").isNotNull())
    pool = users.join(open_ones, "user_id")
    return pool if annotated is None else pool.join(annotated.select("user_id"), "user_id", "left_anti")


def feature_accounts(users: DataFrame, features: DataFrame) -> DataFrame:
    """Users that occur as account features of a classifier."""
    named = features.where(F.col("type").isin("RT", "REPLY", "QUOTE")).select(
        F.element_at(F.split("label", ":"), 2).try_cast("long").alias("user_id"))
    return users.join(named.where(F.col("user_id").isNotNull()), "user_id", "left_semi")


def weak_candidates(pool: DataFrame, score: str, low: float = 0.55, high: float = 0.75, least: int = 15,
                    most_active: int = 1000, n: int = 10, seed: int = 42) -> DataFrame:
    """A sample of the most active users with a middling score; empty when too few."""
    weak = pool.where(F.col(score).between(low, high))
    active = top_rows(weak, most_active, [F.desc("dataset_posts"), F.asc("user_id")])
    enough = F.count(F.lit(1)).over(Window.partitionBy()) >= least  # over the most active alone
    active = active.withColumn("_enough", enough).where("_enough").drop("_enough")
    return top_rows(active, n, [hash_order("user_id", seed=seed), F.asc("user_id")])


def posts_of_users(posts: DataFrame, users: DataFrame, start: str | None = None, end: str | None = None,
                   max_posts: int | None = None, columns: Sequence[str] = ("id", "date", "user_id", "text")) -> DataFrame:
    """Distinct posts of some users in a range of days, oldest first when limited.

    Of rows with one id the oldest stays.  A limit is taken on ids and days,
    so only the texts of the posts that it leaves are exchanged.
    """
    chosen = experiment_slice(posts, start, end).join(users.select("user_id"), "user_id", "left_semi")
    chosen = chosen.select(*columns)
    oldest = [F.asc("date"), F.asc("id")]
    if max_posts is not None:
        first = top_rows(chosen.groupBy("id").agg(F.min("date").alias("date")), max_posts, oldest)
        first = first.select(F.col("id").alias("_id"), F.col("date").alias("_date"))
        same = F.col("id").eqNullSafe(F.col("_id")) & F.col("date").eqNullSafe(F.col("_date"))
        chosen = chosen.join(first, same, "left_semi")
    chosen = pick_one(chosen, ["id"], [c for c in ("date", "user_id") if c in columns])
    return chosen if max_posts is None else top_rows(chosen, max_posts, oldest)


def cross_group_edges(edges: DataFrame, users: DataFrame, most: int = 1000) -> DataFrame:
    """Accounts most repeated by users of another class, with the weights."""
    own = users.select(F.col("user_id").alias("src"), F.col("predicted_class").alias("source_class"))
    other = users.select(F.col("user_id").alias("dst"), F.col("predicted_class").alias("target_class"))
    joined = edges.join(own, "src").join(other, "dst", "left")
    crossing = joined.where(~F.col("source_class").eqNullSafe(F.col("target_class")))
    totals = crossing.groupBy("dst").agg(F.sum("weight").alias("weight"))
    return top_rows(totals, most, [F.desc("weight"), F.asc("dst")])


def posts_sample_per_user(posts: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """At most ``n`` posts of each user, the same ones on every run."""
    return top_rows(posts, n, [hash_order("id", seed=seed), F.asc("id")], within=["user_id"])
