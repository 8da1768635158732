"""Boosted trees over long feature cells, in which every column takes part."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from agorasift.operators import histograms as H
from agorasift.operators import scores as S
from agorasift.operators.durable import durable, scratch_path

ROWS_AT_ONCE = 256  # of a batch, whose used columns are held densely


def sparse_vectors(cells: DataFrame, size: int, rows: DataFrame | None = None, row: str = "row_id",
                   column: str = "feature_id") -> DataFrame:
    """One sparse vector per row; rows of ``rows`` without a cell get an empty one.

    A row's list is as long as its non-zero columns.  The vectors are written
    in the storage layout of the vector type and read back as vectors, which
    keeps the whole step out of Python.
    """
    pairs = cells.groupBy(row).agg(
        F.sort_array(F.collect_list(F.struct(F.col(column).cast("int").alias("i"), F.col("value").cast("double").alias("v")))).alias("p")
    )
    if rows is not None:
        pairs = rows.select(row).join(pairs, row, "left").withColumn(
            "p", F.coalesce("p", F.array().cast("array<struct<i: int, v: double>>")))
    stored = pairs.select(row, F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        F.transform("p", lambda e: e["i"]).alias("indices"), F.transform("p", lambda e: e["v"]).alias("values"),
    ).alias("features"))
    path = scratch_path(cells.sparkSession, "vectors")
    stored.write.parquet(path)
    schema = StructType([stored.schema[row], StructField("features", VectorUDT())])
    return cells.sparkSession.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class Split:
    """Node ``node`` of the tree of a class in a round: ``value > cut`` goes to child ``2 * node + 1``, else ``2 * node``."""

    turn: int
    code: int
    node: int
    feature: int
    cut: float
    gain: float


@dataclass(frozen=True)
class Leaf:
    turn: int
    code: int
    node: int
    value: float


@dataclass
class BoostedClassifier:
    """One boosted model per class, probabilities scaled to sum to one.

    Input is long: cells (row_id, feature_id, value), a missing cell is zero.
    Values of the labelled rows are binned by quantiles of their column, and
    ``histograms.fit`` grows the trees on them.  No column is left out, and
    the model's size follows rounds and depth, not the vocabulary.

    Rows without a label are left out of training; a share of the labelled
    rows stops the boosting once it has not gained for ``patience`` rounds;
    classes weigh the same in total.  ``subsample`` is the share of rows that
    each round learns from; ``max_delta_step`` bounds the leaves (0: no bound).
    """

    rounds: int = 250
    depth: int = 3
    step: float = 0.1
    bins: int = 16
    smoothing: float = 1.0
    patience: int = 20
    validation_share: float = 0.15
    subsample: float = 1.0
    max_delta_step: float = 0.0
    seed: int = 42
    classes: list[str] = field(default_factory=list)
    splits: list[Split] = field(default_factory=list)
    leaves: list[Leaf] = field(default_factory=list)
    calibrators: list[IsotonicRegressionModel] = field(default_factory=list)

    def fit(self, cells: DataFrame, labels: DataFrame) -> "BoostedClassifier":
        """``labels`` holds row_id and label; rows with a null label are ignored."""
        known = labels.where(F.col("label").isNotNull()).select("row_id", "label")
        split = durable(S.stratified_split(known, self.validation_share, "label", "row_id", self.seed))
        weighted = S.balanced_weights(split.where(~F.col("validation")), "label").unionByName(
            split.where(F.col("validation")).withColumn("weight", F.lit(1.0)))
        coded, self.classes = S.label_encode(weighted, "label", "code")
        rows = durable(coded.select("row_id", F.col("code").cast("int").alias("code"), "validation", "weight"))
        own = durable(cells.join(rows.select("row_id", "validation"), "row_id").where("value <> 0"))
        cuts = durable(self._cuts(own.where("NOT validation")))
        bins = durable(self._binned(own, cuts))
        settings = H.Settings(self.rounds, self.depth, self.step, self.smoothing, self.patience, self.subsample, self.max_delta_step, self.seed)
        trees = H.fit(rows, bins, len(self.classes), settings)
        values = self._cut_values(cuts, sorted({s[:2] for t in trees for s in t.splits.values()}))
        self.splits = [Split(t.turn, t.code, node, feature, values[feature, threshold], gain)
                       for t in trees for node, (feature, threshold, gain) in sorted(t.splits.items())]
        self.leaves = [Leaf(t.turn, t.code, node, value) for t in trees for node, value in sorted(t.leaves.items())]
        return self

    def _cuts(self, cells: DataFrame) -> DataFrame:
        """(feature_id, cuts, zero): quantiles of the values that are not zero, and zero itself at place ``zero``."""
        if not 1 < self.bins < H.ZERO:
            raise ValueError(f"bins must be between 2 and {H.ZERO - 1}")
        shares = F.array(*[F.lit(i / self.bins) for i in range(1, self.bins)])
        quantiles = F.percentile_approx(F.col("value").cast("double"), shares, F.lit(1000))
        cuts = cells.groupBy("feature_id").agg(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), quantiles))).alias("cuts"))
        return cuts.withColumn("zero", F.size(F.filter("cuts", lambda c: c < 0)))

    @staticmethod
    def _binned(cells: DataFrame, cuts: DataFrame) -> DataFrame:
        """(row_id, feature_id, bin): cuts below the value, less those below zero; cells in the bin of zero are left out."""
        below = F.size(F.filter("cuts", lambda c: c < F.col("value"))) - F.col("zero")
        return cells.join(cuts, "feature_id").select("row_id", F.col("feature_id").cast("long").alias("feature_id"), below.alias("bin")).where("bin <> 0")

    @staticmethod
    def _cut_values(cuts: DataFrame, used: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """The cut below each bin that a tree uses."""
        wanted = cuts.sparkSession.createDataFrame(list(used), "feature_id long, threshold int")
        found = cuts.join(wanted, "feature_id").select("feature_id", "threshold", F.get("cuts", F.col("zero") + F.col("threshold") - 1).alias("cut"))
        return {(r["feature_id"], r["threshold"]): r["cut"] for r in found.collect()}  # as large as the model

    def raw_probabilities(self, cells: DataFrame, rows: DataFrame) -> DataFrame:
        """One probability column ``p_<code>`` per class, each from its own model, for all of ``rows``.

        Only cells of features that a tree uses are gathered, as many per row
        as the model has at most.
        """
        features = sorted({s.feature for s in self.splits})
        place = {f: i for i, f in enumerate(features)}
        known = cells.sparkSession.createDataFrame(list(place.items()), "feature_id long, at int")
        held = cells.join(F.broadcast(known), "feature_id").groupBy("row_id").agg(
            F.collect_list("at").alias("_at"), F.collect_list(F.col("value").cast("double")).alias("_value"))
        codes, columns, cuts, values = self._heaps(place)
        depth, width, classes = self.depth, len(features), len(self.classes)

        def margins(dense: np.ndarray) -> np.ndarray:
            """Each tree is a heap: a node without a split has column -1 and keeps its rows."""
            margin, row = np.zeros((len(dense), classes)), np.arange(len(dense))
            for code, column, cut, value in zip(codes, columns, cuts, values):
                node = np.ones(len(dense), int)
                for _ in range(depth):
                    at = column[node]
                    node = np.where(at < 0, node, 2 * node + (dense[row, at] > cut[node]))
                margin[:, code] += value[node]
            return margin

        def score(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for batch in batches:
                at, value, found = batch.pop("_at"), batch.pop("_value"), []
                for first in range(0, len(batch), ROWS_AT_ONCE):
                    part = slice(first, first + ROWS_AT_ONCE)
                    dense = np.zeros((len(at[part]), max(width, 1)))
                    for i, (where, what) in enumerate(zip(at[part], value[part])):
                        if where is not None:
                            dense[i, where] = what
                    found.append(margins(dense))
                margin = np.concatenate(found) if found else np.zeros((0, classes))
                for code in range(classes):
                    batch[f"p_{code}"] = 1 / (1 + np.exp(-margin[:, code]))
                yield batch

        joined = rows.join(held, "row_id", "left")
        schema = StructType([*rows.schema.fields, *[StructField(f"p_{c}", DoubleType()) for c in range(classes)]])
        return joined.mapInPandas(score, schema)

    def _heaps(self, place: dict[int, int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Class of each tree, and the column, cut and value of each of its nodes."""
        trees = sorted({(s.turn, s.code) for s in self.splits} | {(leaf.turn, leaf.code) for leaf in self.leaves})
        at, shape = {t: i for i, t in enumerate(trees)}, (len(trees), 2 << self.depth)
        columns, cuts, values = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        for s in self.splits:
            tree = at[s.turn, s.code]
            columns[tree, s.node], cuts[tree, s.node] = place[s.feature], s.cut
        for leaf in self.leaves:
            values[at[leaf.turn, leaf.code], leaf.node] = leaf.value
        return [code for _, code in trees], columns, cuts, values

    def calibrate(self, cells: DataFrame, labels: DataFrame) -> "BoostedClassifier":
        """Isotonic map per class from held-out labelled rows."""
        held = durable(self.raw_probabilities(cells, labels.where(F.col("label").isNotNull()).select("row_id", "label")))
        self.calibrators = [
            IsotonicRegression(featuresCol=f"p_{code}", labelCol="_hit").fit(
                held.withColumn("_hit", (F.col("label") == name).cast("double")))
            for code, name in enumerate(self.classes)
        ]
        return self

    def predict(self, cells: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` with normalised ``p_<code>`` columns and ``predicted_class``."""
        scored = self.raw_probabilities(cells, rows)
        names = [f"p_{i}" for i in range(len(self.classes))]
        for name, model in zip(names, self.calibrators):
            scored = model.copy().setPredictionCol("_iso").transform(scored).withColumn(name, F.col("_iso")).drop("_iso")
        total = sum(F.col(n) for n in names)
        even = F.lit(1.0 / len(names))
        scored = scored.withColumn("_total", total).withColumns(
            {n: F.when(F.col("_total") > 0, F.try_divide(F.col(n), F.col("_total"))).otherwise(even) for n in names}
        ).drop("_total")
        return S.argmax_class(scored, dict(zip(names, self.classes)))

    def importances(self, dictionary: DataFrame) -> DataFrame:
        """Share of the total gain of each feature, joined to its name; zero where no tree uses it."""
        gains: dict[int, float] = {}
        for s in self.splits:
            gains[s.feature] = gains.get(s.feature, 0.0) + s.gain
        total = sum(gains.values()) or 1.0
        used = dictionary.sparkSession.createDataFrame(
            [(f, g / total) for f, g in sorted(gains.items())], "feature_id long, importance double")
        return dictionary.join(used, "feature_id", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))

    def save(self, spark: SparkSession, path: str, **tables: DataFrame) -> None:
        """Settings, classes, trees and calibration under one folder, and any tables that belong to them."""
        settings = {k: v for k, v in vars(self).items() if k not in ("splits", "leaves", "calibrators")}
        spark.createDataFrame([(json.dumps(settings), len(self.calibrators))], "settings string, calibrators int").write.mode("overwrite").parquet(f"{path}/settings")
        for name, items, schema in (("splits", self.splits, _SPLITS), ("leaves", self.leaves, _LEAVES)):
            spark.createDataFrame([tuple(asdict(i).values()) for i in items], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        for code, model in enumerate(self.calibrators):
            model.write().overwrite().save(f"{path}/calibration-{code}")
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedClassifier":
        stored = spark.read.parquet(f"{path}/settings").first()
        rows = lambda name: sorted(map(tuple, spark.read.parquet(f"{path}/{name}").collect()))  # noqa: E731  # as large as the model
        return cls(**json.loads(stored["settings"]), splits=[Split(*r) for r in rows("splits")], leaves=[Leaf(*r) for r in rows("leaves")],
                   calibrators=[IsotonicRegressionModel.load(f"{path}/calibration-{c}") for c in range(stored["calibrators"])])


_SPLITS = "turn int, code int, node int, feature long, cut double, gain double"
_LEAVES = "turn int, code int, node int, value double"


def classify(cells: DataFrame, labels: DataFrame, classifier: BoostedClassifier, users: DataFrame,
             allowed: Sequence[int] = (), assigned: str = "undisclosed", offset: float = 0.1) -> DataFrame:
    """Fit, predict, then apply threshold, known labels and allowed accounts.

    ``users`` holds all rows (row_id, user_id); the allowed accounts are user ids.
    """
    classifier.fit(cells, labels)
    columns = {f"p_{i}": c for i, c in enumerate(classifier.classes)}
    rows = users.select("row_id", "user_id").join(labels.select("row_id", F.col("label").alias("reported_label")), "row_id", "left")
    predicted = S.preserve_labels(S.threshold_class(classifier.predict(cells, rows), columns, offset))
    return S.allow_accounts(predicted, allowed, assigned)


def cross_validate(cells: DataFrame, labels: DataFrame, make_classifier, folds: int = 5, seed: int = 42) -> DataFrame:
    """Report of each fold; folds keep the share of every class and of unlabelled rows."""
    rows = durable(S.fold_assignment(labels.select("row_id", "label"), folds, "label", "row_id", seed))
    reports = None
    for fold in range(folds):
        classifier = make_classifier().fit(cells, rows.where(F.col("fold") != fold))
        held = rows.where((F.col("fold") == fold) & F.col("label").isNotNull())
        report = S.classification_report(classifier.predict(cells, held), "label", "predicted_class").withColumn("fold", F.lit(fold))
        reports = report if reports is None else reports.unionByName(report)
    return reports
