"""Users, daily statistics and words by predicted group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def _valid(predictions: DataFrame, name: str) -> DataFrame:
    return predictions.where(F.col("predicted_class") != "noise").select(
        "user_id", F.col("predicted_class").alias(f"predicted_{name}"))


def consolidate_users(users: DataFrame, group: str, predictions: DataFrame,
                      others: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Users with their class in every group; noise in any group leaves them out."""
    result = users.join(_valid(predictions, group), "user_id")
    for name, other in (others or {}).items():
        if name not in ("relevance", group):
            result = result.join(_valid(other, name), "user_id")
    return result


def daily_stats_by_group(stats: DataFrame, users: DataFrame, predictions: DataFrame, group: str) -> DataFrame:
    """Daily statistics of the consolidated users with their class."""
    return stats.join(users.select("user_id"), "user_id", "left_semi").join(_valid(predictions, group), "user_id")


def word_frequencies(user_tokens: DataFrame, predictions: DataFrame, group: str) -> DataFrame:
    """Users and occurrences of each token, per class and day."""
    tagged = user_tokens.join(_valid(predictions, group), "user_id")
    return tagged.groupBy(f"predicted_{group}", "token", "date").agg(
        F.count(F.lit(1)).alias("n_users"), F.sum("frequency").alias("frequency"))
