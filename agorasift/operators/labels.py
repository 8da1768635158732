"""Weak supervision: rule labels, votes, overrides, feature assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from agorasift.functions import text as T
from agorasift.operators.ranking import hash_order, number_rows

LEFT_OUT = ("noise", "undisclosed")


def eligible_users(users: DataFrame, relevance: DataFrame, allowed: Sequence[int] = (),
                   left_out: Sequence[str] = LEFT_OUT) -> DataFrame:
    """Users whose relevance class counts, plus allowed accounts that were classified."""
    keep = ~F.col("predicted_class").isin(*left_out)
    if allowed:
        keep = keep | F.col("user_id").isin(*allowed)
    return users.join(relevance.where(keep).select("user_id"), "user_id", "left_semi")


def pattern_labels(df: DataFrame, text: Column, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(user_id, class)`` for every class with a matching pattern.

    Text and patterns are both freed of accents; one pass over the rows, with
    one alternation per class.
    """
    plain = T.deaccent(F.coalesce(text, F.lit("")))
    hits = F.array_compact(
        F.array(*[F.when(plain.rlike("(?i)" + _plain_pattern(p)), F.lit(name)) for name, p in patterns.items()])
    )
    return df.select("user_id", F.explode(hits).alias("class"))


def _plain_pattern(patterns: Sequence[str]) -> str:
    return "|".join(patterns).translate(str.maketrans(T._ACCENTED, T._PLAIN))


def known_with_locations(known: DataFrame, hits: DataFrame) -> DataFrame:
    """Configured accounts joined by the accounts that a location pattern hits."""
    return known.select("user_id", "class").unionByName(hits.select("user_id", "class")).distinct()


def age_labels(profiles: DataFrame, classes: Sequence[str], text: str = "description") -> DataFrame:
    """``(user_id, class)`` from the age told in the biography."""
    bins = T.age_bin(T.age_from_biography(F.coalesce(text, F.lit(""))), classes)
    return profiles.select("user_id", F.explode(F.array_compact(F.array(bins))).alias("class"))


def rule_labels(features: DataFrame, rules: DataFrame, family: str) -> DataFrame:
    """``(row_id, class)`` for rows with a wanted token and no unwanted one.

    ``features`` holds (row_id, type, token, value); ``rules`` is the small
    configured table (class, family, kind, token).
    """
    own = rules.where(F.col("family") == family).select("class", "kind", "token")
    cells = features.where((F.col("type") == family) & (F.col("value") > 0)).select("row_id", "token")
    hits = cells.join(own, "token").groupBy("row_id", "class").agg(
        F.count_if(F.col("kind") == "must_have").alias("wanted"),
        F.count_if(F.col("kind") == "cant_have").alias("unwanted"),
    )
    return hits.where((F.col("wanted") > 0) & (F.col("unwanted") == 0)).select("row_id", "class")


def label_votes(features: DataFrame, rules: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Votes per row and class, one from each family of rules.

    All families are judged in one pass, grouped by family too.  ``prior``
    holds labels found elsewhere (location, age), one vote each.
    """
    cells = features.where(F.col("value") > 0).select("row_id", F.col("type").alias("family"), "token")
    hits = cells.join(rules, ["family", "token"]).groupBy("row_id", "family", "class").agg(
        F.count_if(F.col("kind") == "must_have").alias("wanted"),
        F.count_if(F.col("kind") == "cant_have").alias("unwanted"),
    )
    labels = hits.where((F.col("wanted") > 0) & (F.col("unwanted") == 0)).select("row_id", "class")
    if prior is not None:
        labels = labels.unionByName(prior.select("row_id", "class"))
    return labels.groupBy("row_id", "class").agg(F.count(F.lit(1)).alias("votes"))


def drop_conflicts(votes: DataFrame) -> DataFrame:
    """Votes of the rows that have votes for one class only."""
    sure = votes.where(F.col("votes") > 0).groupBy("row_id").agg(
        F.countDistinct("class").alias("_n"), F.first("class").alias("class"), F.sum("votes").alias("votes")
    )
    return sure.where(F.col("_n") == 1).select("row_id", "class", "votes")


def cap_labels(votes: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``cap`` rows, one vote each, of classes with more votes than the cap.

    Rows are ranked over all tasks, so one large class is no single task's work.
    """
    totals = votes.groupBy("class").agg(F.sum("votes").alias("_total"))
    ranked = number_rows(votes, [hash_order("row_id", seed=seed), F.col("row_id")], "_at", within=["class"])
    return (
        ranked.join(totals, "class")
        .where((F.col("_total") <= cap) | (F.col("_at") < cap))
        .select("row_id", "class",
                F.when(F.col("_total") > cap, F.lit(1).cast("long")).otherwise(F.col("votes")).alias("votes"))
    )


def manual_labels(votes: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """Hand-tagged accounts get exactly one vote for their class and no other.

    An account tagged twice keeps the tag of the later class name.
    """
    tagged = (
        known.join(rows.select("user_id", "row_id"), "user_id").groupBy("row_id").agg(F.max("class").alias("class"))
        .withColumn("votes", F.lit(1).cast("long"))
    )
    return votes.join(tagged.select("row_id"), "row_id", "left_anti").unionByName(tagged)


def without_accounts(votes: DataFrame, allowed: Sequence[int], rows: DataFrame) -> DataFrame:
    """Allowed accounts lose their labels."""
    if not allowed:
        return votes
    listed = rows.where(F.col("user_id").isin(*allowed)).select("row_id")
    return votes.join(listed, "row_id", "left_anti")


def remove_seeds(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Feature cells whose column did not decide a label."""
    seeds = rules.where(F.col("kind") == "must_have").select(F.col("family").alias("type"), "token").distinct()
    return features.join(seeds, ["type", "token"], "left_anti")


def single_label(votes: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Class with most votes; the earlier configured class wins a tie."""
    order = reduce(lambda rest, i: F.when(F.col("class") == classes[i], F.lit(-i)).otherwise(rest),
                   range(len(classes)), F.lit(-len(classes)))
    return votes.where(F.col("votes") > 0).groupBy("row_id").agg(
        F.max_by("class", F.struct("votes", order.alias("o"))).alias("label")
    )


def tfidf(coo: DataFrame, rows: int | None = None, norm: str | None = "l2", row: str = "row_id",
          column: str = "token_id", idf: DataFrame | None = None) -> DataFrame:
    """Smooth tf-idf; rows scaled to sum (l1) or length (l2) one.

    ``idf`` comes from ``inverse_frequency`` when other rows are to be weighted.
    """
    idf = inverse_frequency(coo, rows, row, column) if idf is None else idf
    weighted = coo.join(idf, column).withColumn("value", F.col("value") * F.col("idf")).drop("idf")
    if norm is None:
        return weighted
    size = F.sum("value") if norm == "l1" else F.sqrt(F.sum(F.col("value") * F.col("value")))
    sizes = weighted.groupBy(row).agg(size.alias("_size"))
    return weighted.join(sizes, row).withColumn("value", F.col("value") / F.col("_size")).drop("_size")


def inverse_frequency(coo: DataFrame, rows: int | None = None, row: str = "row_id", column: str = "token_id") -> DataFrame:
    """``ln((1 + n) / (1 + df)) + 1`` per column."""
    if rows is None:
        rows = coo.select(row).distinct().count()
    found = coo.where(F.col("value") != 0).groupBy(column).agg(F.count(F.lit(1)).alias("_df"))
    return found.select(column, (F.ln(F.lit(1.0 + rows) / (F.col("_df") + 1)) + 1).alias("idf"))


def group_edges(edges: DataFrame, labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Weight of each user's edges into labelled users, one column per class."""
    into = edges.join(labels.select(F.col("user_id").alias("dst"), "class"), "dst")
    return into.groupBy("src").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("weight")).otherwise(F.lit(0))).cast("long").alias(c) for c in classes]
    )


def group_edge_features(wide: DataFrame, classes: Sequence[str], family: str, rows: DataFrame) -> DataFrame:
    """The same as feature cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("token"), F.col(c).cast("double").alias("value")) for c in classes])
    long = wide.select(F.col("src").alias("user_id"), F.explode(cells).alias("c")).select("user_id", "c.*")
    return long.where(F.col("value") != 0).join(rows.select("user_id", "row_id"), "user_id").select(
        "row_id", F.lit(family).alias("type"), "token", "value")


def assemble_features(blocks: Sequence[DataFrame]) -> DataFrame:
    """All blocks as one long table (row_id, type, token, value)."""
    parts = [b.select("row_id", "type", F.col("token").cast("string").alias("token"), F.col("value").cast("double").alias("value"))
             for b in blocks]
    return reduce(DataFrame.unionByName, parts)


def feature_dictionary(features: DataFrame, families: Sequence[str]) -> DataFrame:
    """Dense ids over all columns that are not zero, block by block.

    Counts have no cell below zero; elements of vectors may have.
    """
    order = reduce(lambda rest, i: F.when(F.col("type") == families[i], F.lit(i)).otherwise(rest),
                   range(len(families)), F.lit(len(families)))
    sums = features.groupBy("type", "token").agg(
        F.sum("value").alias("matrix_sum"), F.max(F.abs("value")).alias("_largest"))
    return number_rows(
        sums.where(F.col("_largest") > 0).drop("_largest"), [order, F.desc("matrix_sum"), F.asc("token")], "feature_id")


def feature_cells(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Matrix over the dictionary: (row_id, feature_id, value)."""
    return features.join(dictionary.select("type", "token", "feature_id"), ["type", "token"]).groupBy(
        "row_id", "feature_id").agg(F.sum("value").alias("value"))
