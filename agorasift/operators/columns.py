"""Whole-column operations: summaries, scaling, histograms, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from agorasift.operators.ranking import exact_quantiles, hash_order, top_rows


def select_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns whose name is the prefix or begins with it and an underscore."""
    return df.select([c for c in df.columns if c == prefix or c.startswith(prefix + "_")])


def normalize_rows(coo: DataFrame, row: str = "row_id", value: str = "value") -> DataFrame:
    """Entries divided by their row sum; rows that sum to 0 give 0."""
    sums = coo.groupBy(row).agg(F.sum(value).alias("_sum"))
    share = F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_sum").cast("double")), F.lit(0.0))
    return coo.join(sums, row).withColumn(value, share).drop("_sum")


def zscore_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean, over their population deviation."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    scaled = {}
    for c in columns:
        mean, deviation = stats[f"m_{c}"], stats[f"s_{c}"]
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(deviation) if deviation else F.lit(0.0)
    return df.withColumns(scaled)


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per column."""
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
        .alias("c")
    ).select("c.*").where(F.col("value").isNotNull())
    moments = stacked.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(stacked, "value", (0.25, 0.5, 0.75), within=["name"])
    wide = quartiles.groupBy("name").agg(
        *[F.max(F.when(F.col("share") == q, F.col("value"))).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    )
    return moments.join(wide, "name")


def seeded_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones on every run."""
    return top_rows(df, n, [hash_order(*keys, seed=seed), *[F.col(k) for k in keys]])


def frequency_histogram(df: DataFrame, column: str, bins: int = 20, log: bool = False) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value."""
    value = F.ln(F.col(column)) if log else F.col(column).cast("double")
    levels = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ends = levels.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None:
        return levels.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return levels.groupBy(place.alias("bin")).agg(F.sum("n").alias("n"))


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pearson correlation of each left column with each right one, nulls as 0."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*left, *right)])
    wide = filled.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in left for b in right])
    cells = F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("correlation"))
        for a in left for b in right
    ])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def row_maximum(columns: Sequence[str]) -> tuple[Column, Column]:
    """Largest of the columns and the name of the first that reaches it."""
    best = F.greatest(*[F.col(c) for c in columns])
    name = reduce(lambda rest, c: F.when(F.col(c) == best, F.lit(c)).otherwise(rest),
                  reversed(columns), F.lit(None).cast("string"))
    return best, name
