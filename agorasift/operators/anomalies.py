"""Behaviour features of users and isolation-forest scores."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from agorasift.functions import dates as D
from agorasift.functions import numeric as N
from agorasift.functions import text as T
from agorasift.operators.ranking import pick_one

VOLUMES = ("statuses_count", "rts_count", "quotes_count", "replies_count")


def user_volume(stats: DataFrame) -> DataFrame:
    """Logarithm of what each user posted over all days."""
    return stats.groupBy("user_id").agg(*[F.log1p(F.sum(c)).alias(f"transformed_{c}") for c in VOLUMES])


def friend_ratio(users: DataFrame) -> DataFrame:
    """Log friends over log followers, and digits in the screen name."""
    return users.select(
        "user_id",
        N.log_ratio(F.col("friends_count"), F.col("followers_count")).alias("ratio_friends_over_followers"),
        T.digit_count(F.col("screen_name")).alias("n_digits_username"),
    )


def component_cells(components: DataFrame, layer: str, least: int = 10) -> DataFrame:
    """One-hot membership in the components with enough nodes, in long form: the ones, however many components there are."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return components.join(sizes.select("component"), "component", "left_semi").select(
        F.col("node").alias("user_id"),
        F.concat(F.lit(f"{layer}_component_"), F.col("component")).alias("feature"), F.lit(1.0).alias("value"))


def component_of(components: DataFrame, layer: str, least: int = 10) -> DataFrame:
    """The component of each user with enough nodes, as one categorical column; it stands for all 0/1 columns."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return components.join(sizes.select("component"), "component", "left_semi").select(
        F.col("node").alias("user_id"), F.col("component").alias(f"{layer}_component"))


def active_days(stats: DataFrame, users: DataFrame) -> DataFrame:
    """Days with posts, and posts per such day."""
    days = stats.groupBy("user_id").agg(F.countDistinct("date").alias("active_days"))
    return users.select("user_id", "dataset_posts").join(days, "user_id", "left").select(
        "user_id", F.coalesce("active_days", F.lit(0)).alias("active_days"),
        N.safe_ratio(F.col("dataset_posts"), F.col("active_days")).alias("daily_rhythm"))


def global_rhythm(users: DataFrame, reference: str) -> DataFrame:
    """Account age at the reference instant, and log counters per day of age."""
    age = D.days_between(F.lit(reference), F.col("created_at"))
    aged = users.withColumn("account_age_days", age)

    def per_day(counter: str) -> Column:
        return N.safe_ratio(F.log1p(counter), F.col("account_age_days") + 1)

    return aged.select(
        "user_id", "account_age_days", per_day("statuses_count").alias("global_daily_rhythm"),
        per_day("followers_count").alias("global_follower_rhythm"), per_day("friends_count").alias("global_friend_rhythm"))


def relative_volume(volume: DataFrame, days: DataFrame) -> DataFrame:
    """Log volumes divided by the active days."""
    joined = volume.join(days.select("user_id", "active_days"), "user_id", "left")
    return joined.select("user_id", *[
        N.safe_ratio(F.col(f"transformed_{c}"), F.col("active_days")).alias(f"transformed_{c}") for c in VOLUMES])


def first_last_snapshot(stats: DataFrame) -> DataFrame:
    """First and last row of each user, marked; a single day is both."""
    first = pick_one(stats, ["user_id"], ["date"]).withColumn("snapshot", F.lit("first"))
    return first.unionByName(pick_one(stats, ["user_id"], ["date"], last=True).withColumn("snapshot", F.lit("last")))


def counter_diff(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Change of counters up to the user's next day.

    Rows are unique per user and day, so a user's window is no longer than the
    number of days.
    """
    window = Window.partitionBy("user_id").orderBy("date")
    nexts = stats.select(
        "user_id", F.lead("date").over(window).alias("date_end"),
        *[(F.lead(c).over(window) - F.col(c)).alias(f"{c}_diff") for c in columns])
    return nexts.where(F.col("date_end").isNotNull())


def feature_table(users: DataFrame, parts: Sequence[DataFrame], categories: Sequence[str] = ()) -> DataFrame:
    """All features of the users in one row each, with gaps as 0; categories stay null where they are missing."""
    joined = reduce(lambda a, b: a.join(b, "user_id", "left"), parts, users.select("user_id"))
    kept = [F.col(c) if c in categories else N.repair(F.col(c)).alias(c) for c in joined.columns if c != "user_id"]
    return joined.select("user_id", *kept)


def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points (Liu et al., 2008)."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(data: np.ndarray, groups: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (id, column, cut, member, left, right, depth value); column -1 marks a leaf.

    Columns from ``data``'s width on are those of ``groups`` (-1: no member):
    each member is a 0/1 column of its own, and its rows go right.
    """
    nodes: list[tuple] = [()]
    work = [(0, np.arange(len(data)), 0)]
    while work:
        at, rows, depth = work.pop()
        part = data[rows]
        choices = [(int(c), None) for c in np.flatnonzero(part.max(axis=0) > part.min(axis=0))] if len(rows) > 1 else []
        for c in range(groups.shape[1]) if len(rows) > 1 else ():
            members, sizes = np.unique(groups[rows, c], return_counts=True)
            choices += [(data.shape[1] + c, int(m)) for m, n in zip(members, sizes) if m >= 0 and n < len(rows)]
        if depth >= limit or not choices:
            nodes[at] = (at, -1, 0.0, -1, -1, -1, depth + float(_average_path(len(rows))))
            continue
        column, member = choices[int(rng.integers(len(choices)))]
        cut = 0.0
        if member is None:
            cut = float(rng.uniform(part[:, column].min(), part[:, column].max()))
            left = part[:, column] <= cut
        else:
            left = groups[rows, column - data.shape[1]] != member
        children = (len(nodes), len(nodes) + 1)
        nodes += [(), ()]
        nodes[at] = (at, column, cut, -1 if member is None else member, *children, 0.0)
        work += [(children[0], rows[left], depth + 1), (children[1], rows[~left], depth + 1)]
    return nodes


def isolation_scores(features: DataFrame, trees: int = 100, sample: int = 1000, seed: int = 666,
                     key: str = "user_id", categories: Sequence[str] = ()) -> DataFrame:
    """Adds ``score``; negative values are anomalous.

    ``categories`` are columns of non-negative ids; each id counts as a 0/1
    column, without a wide table.

    Each row enters the sample of a tree by a hash of its key, so only about
    ``trees * sample`` rows are shuffled, and one task grows a tree from a
    sample of bounded size.  The forest has at most ``2 * sample`` nodes per
    tree; it is sent to the tasks that score all rows.
    """
    columns = [c for c in features.columns if c != key and c not in categories]
    members = lambda pdf: np.column_stack([pdf[c].fillna(-1).astype("int64") for c in categories]) if categories else np.zeros((len(pdf), 0), int)
    rows = features.count()
    take = min(sample, rows)
    # a little more than the sample, cut to size inside the group
    share = 1.0 if rows <= sample else min(1.0, (take + 6 * math.sqrt(take)) / rows)
    bound = int(share * (1 << 31))

    def drawn(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 31))

    wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: drawn(i) < F.lit(bound))
    sampled = features.withColumn("tree", F.explode(wanted)).withColumn("_draw", drawn(F.col("tree")))
    depth_limit = math.ceil(math.log2(max(take, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_draw", key]).head(take)
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(pdf[columns].to_numpy(float), members(pdf), depth_limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "col", "cut", "member", "lo", "hi", "length"])

    forest = sampled.groupBy("tree").applyInPandas(
        grow, "tree int, node int, col int, cut double, member long, lo int, hi int, length double"
    ).toPandas()
    model = {
        int(tree): tuple(part.sort_values("node")[c].to_numpy() for c in ("col", "cut", "member", "lo", "hi", "length"))
        for tree, part in forest.groupby("tree")
    }
    shared = features.sparkSession.sparkContext.broadcast(model)
    norm = float(_average_path(take)) or 1.0

    def score(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            data, groups = pdf[columns].to_numpy(float), members(pdf)
            width, both = len(columns), np.column_stack([data, np.zeros((len(data), len(categories)))])
            total = np.zeros(len(data))
            for col, cut, member, lo, hi, length in shared.value.values():
                at = np.zeros(len(data), dtype=int)
                while True:
                    inner = np.flatnonzero(col[at] >= 0)
                    if len(inner) == 0:
                        break
                    node = at[inner]
                    below = both[inner, col[node]] <= cut[node]
                    for c in range(len(categories)):
                        mine = col[node] == width + c
                        below[mine] = groups[inner[mine], c] != member[node[mine]]
                    at[inner] = np.where(below, lo[node], hi[node])
                total += length[at]
            depth = total / max(len(shared.value), 1)
            yield pdf.assign(score=0.5 - np.power(2.0, -depth / norm))

    return features.mapInPandas(score, features.withColumn("score", F.lit(0.0)).schema)


def anomaly_labels(scored: DataFrame) -> DataFrame:
    """``anomalous`` below zero, else ``normal``."""
    return scored.withColumn("anomaly_label", F.when(F.col("score") < 0, "anomalous").otherwise("normal"))


def label_shares(labelled: DataFrame, group: str) -> DataFrame:
    """Rows of each anomaly label in each group, and their share of the group."""
    counts = labelled.groupBy(group, "anomaly_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
