"""What happens around a classifier: splits, weights, thresholds, reports, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window, functions as F

from agorasift.functions import text as T
from agorasift.operators.columns import row_maximum
from agorasift.operators.ranking import hash_order, number_rows, top_rows


def label_encode(df: DataFrame, column: str = "class", name: str = "code") -> tuple[DataFrame, list[str]]:
    """Codes 0.. in alphabetical class order; unlabelled rows keep a null code."""
    model = StringIndexer(inputCol=column, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="skip").fit(
        df.where(F.col(column).isNotNull())
    )
    codes = model.labels
    code = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(column)) - 1
    return df.withColumn(name, code.cast("int")), codes


def stratified_split(df: DataFrame, fraction: float, column: str = "class", key: str = "user_id",
                     seed: int = 42) -> DataFrame:
    """Adds ``validation``: that share of each class, or of all rows when a class has one row."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    within = [] if not sizes.where(F.col("_n") == 1).isEmpty() else [column]
    ranked = number_rows(df, [hash_order(key, seed=seed), F.col(key)], "_at", within=within)
    if within:
        ranked = ranked.join(sizes, column)
    else:
        ranked = ranked.withColumn("_n", F.lit(df.count()))
    return ranked.withColumn("validation", F.col("_at") < F.floor(F.col("_n") * F.lit(fraction) + 0.5)).drop("_at", "_n")


def fold_assignment(df: DataFrame, folds: int, column: str = "class", key: str = "user_id", seed: int = 42,
                    null_name: str = "__null__") -> DataFrame:
    """Adds ``fold``; each class, and the rows without one, spread evenly."""
    strata = df.withColumn("_stratum", F.coalesce(column, F.lit(null_name)))
    ranked = number_rows(strata, [hash_order(key, seed=seed), F.col(key)], "_at", within=["_stratum"])
    return ranked.withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_at", "_stratum")


def balanced_weights(df: DataFrame, column: str = "class", name: str = "weight") -> DataFrame:
    """``n / (k * n_class)`` for each row of a class."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    weights = sizes.select(
        column, (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias(name)
    )
    return df.join(weights, column)


def argmax_class(scores: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Adds ``predicted_class``; ``classes`` maps score columns to class names, the first wins a tie."""
    _, column = row_maximum(list(classes))
    return scores.withColumn("predicted_class", _renamed(column, classes))


def _renamed(column: Column, classes: dict[str, str]) -> Column:
    result = None
    for source, name in classes.items():
        test = column == source
        result = F.when(test, F.lit(name)) if result is None else result.when(test, F.lit(name))
    return result


def threshold_class(predictions: DataFrame, classes: dict[str, str], offset: float = 0.1) -> DataFrame:
    """A class whose probability is under ``1/k + offset`` becomes ``undisclosed``."""
    best, _ = row_maximum(list(classes))
    low = best < F.lit(1 / len(classes) + offset)
    return predictions.withColumn("predicted_class", F.when(low, F.lit("undisclosed")).otherwise(F.col("predicted_class")))


def preserve_labels(predictions: DataFrame) -> DataFrame:
    """Known labels win over predictions."""
    return predictions.withColumn("predicted_class", F.coalesce("reported_label", "predicted_class"))


def allow_accounts(predictions: DataFrame, allowed: Sequence[int], assigned: str = "undisclosed") -> DataFrame:
    """Allowed accounts predicted as noise get the assigned class."""
    if not allowed:
        return predictions
    test = F.col("user_id").isin(*allowed) & (F.col("predicted_class") == "noise")
    return predictions.withColumn("predicted_class", F.when(test, F.lit(assigned)).otherwise(F.col("predicted_class")))


def class_distribution(df: DataFrame, column: str = "predicted_class") -> DataFrame:
    """Rows per class, absolute and as a share."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything))


def label_min_probability(scores: DataFrame, classes: dict[str, str], least: float, other: str | None = None,
                          source: str = "model") -> DataFrame:
    """Adds the largest probability, its class when large enough, and the source."""
    best, column = row_maximum(list(classes))
    label = F.when(best < least, F.lit(other).cast("string")).otherwise(_renamed(column, classes))
    return scores.withColumns({"max_probability": best, "label": label, "source": F.lit(source)})


def classification_report(df: DataFrame, label: str = "reported_label", predicted: str = "predicted_class") -> DataFrame:
    """Precision, recall, F1 and support per class, with averages and accuracy.

    Works on the counts of (label, prediction) pairs; an undefined rate is 1.
    """
    pairs = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"),
                     F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"),
                     F.lit(0).cast("long").alias("hits")),
        )).alias("s")
    ).select("s.*").where(F.col("class").isNotNull())
    per_class = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hits").alias("hits"))

    def rate(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(1.0)).otherwise(F.try_divide(top.cast("double"), bottom))

    rates = per_class.select(
        "class", "support", "hits", rate(F.col("hits"), F.col("named")).alias("precision"),
        rate(F.col("hits"), F.col("support")).alias("recall"),
        rate(2 * F.col("hits"), F.col("named") + F.col("support")).alias("f1"),
    )
    measures = ("precision", "recall", "f1")
    macro = rates.agg(F.sum("support").alias("support"), *[F.avg(m).alias(m) for m in measures])
    weighted = rates.agg(
        F.sum("support").alias("support"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
    )
    accuracy = rates.agg(
        F.sum("support").alias("support"),
        *[(F.sum("hits") / F.sum("support")).alias(m) for m in measures],
    )
    columns = ["class", "support", *measures]
    result = rates.select(columns)
    for name, part in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", accuracy)):
        result = result.unionByName(part.withColumn("class", F.lit(name)).select(columns))
    return result


def group_vectors(cells: DataFrame, predictions: DataFrame, columns: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Feature sums of the rows of each predicted class."""
    classes = predictions.where(F.col("predicted_class").isNotNull()).select("row_id", "predicted_class")
    return cells.join(classes, "row_id").groupBy("predicted_class", *columns).agg(F.sum("value").alias("value"))


def log_odds(vectors: DataFrame, classes: Sequence[str], columns: Sequence[str] = ("feature_id",),
             prior: float = 0.001) -> DataFrame:
    """Association of each feature with each class against the rest, as a z-score.

    Log-odds ratio with an uninformative Dirichlet prior (Monroe et al., 2008).
    Every feature gets a score for every class, absent counts as 0.
    """
    wide = vectors.groupBy(*columns).agg(
        *[F.sum(F.when(F.col("predicted_class") == c, F.col("value")).otherwise(0.0)).alias(f"_{i}") for i, c in enumerate(classes)]
    )
    totals = wide.agg(F.count(F.lit(1)).alias("terms"), *[F.sum(f"_{i}").alias(f"n{i}") for i in range(len(classes))]).first()
    mass = prior * totals["terms"]
    in_class = [totals[f"n{i}"] or 0.0 for i in range(len(classes))]
    everything = sum(F.col(f"_{i}") for i in range(len(classes)))

    def score(i: int) -> Column:
        own, rest = F.col(f"_{i}") + prior, everything - F.col(f"_{i}") + prior
        own_mass, rest_mass = in_class[i] + mass, sum(in_class) - in_class[i] + mass
        delta = F.ln(own / (F.lit(own_mass) - own)) - F.ln(rest / (F.lit(rest_mass) - rest))
        return delta / F.sqrt(1 / own + 1 / rest)

    cells = F.array(*[F.struct(F.lit(c).alias("class"), score(i).alias("score")) for i, c in enumerate(classes)])
    return wide.select(*columns, F.explode(cells).alias("c")).select(*columns, "c.*")


def top_terms(associations: DataFrame, k: int, family: str | None = None, prefix: str | None = None) -> DataFrame:
    """The most associated features of each class, by family or name prefix."""
    chosen = associations
    if family is not None:
        chosen = chosen.where(F.col("type") == family)
    if prefix is not None:
        chosen = chosen.where(F.col("token").startswith(prefix))
    return top_rows(chosen, k, [F.desc("score"), F.asc("type"), F.asc("token")], within=["class"])


ACCOUNT_TITLES = ("RT", "MENTION", "QUOTE", "REPLY")


def model_features(associations: DataFrame, importances: DataFrame, users: DataFrame | None = None,
                   relevant_only: bool = True) -> DataFrame:
    """Associations and importances with readable names; account ids become screen names."""
    features = associations.join(importances, ["type", "token"])
    if relevant_only:
        features = features.where(F.col("importance") > 0)
    features = features.withColumns({
        "label": F.concat_ws(":", "type", "token"),
        "type": T.family_title(F.regexp_replace("type", ":", "")),
    })
    if users is not None:
        names = users.select(F.col("user_id").cast("string").alias("token"), "screen_name")
        account = F.col("type").isin(*ACCOUNT_TITLES)
        shown = F.when(account & F.col("screen_name").isNotNull(), F.concat(F.lit("@"), "screen_name")).when(
            account, F.concat(F.lit("ID:"), "token")).otherwise(F.col("token"))
        features = features.join(names, "token", "left").withColumn("token", shown).drop("screen_name")
    return features.withColumn("new_label", F.concat_ws(":", "type", "token"))


def importance_by_type(features: DataFrame) -> DataFrame:
    """Features and mean importance of each type."""
    return features.groupBy("type").agg(F.count(F.lit(1)).alias("n_features"), F.avg("importance").alias("mean_importance"))


def proportion_midpoints(proportions: DataFrame, row: str, order: str, value: str) -> DataFrame:
    """Running sum of the shares of a row and the middle of each share.

    A row has one entry per class, so its window is small.
    """
    up_to = Window.partitionBy(row).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(up_to)
    return proportions.withColumns({"cumulative": total, "midpoint": total - F.col(value) / 2})
