"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from agorasift.llm.arrow import ROWS_AT_ONCE
from agorasift.llm.storage import fresh
from agorasift.llm.textstats import counts_of, labelled_sample, ratio_matrix, ratios, text_counts

SAMPLE = 20_000  # labelled rows that the model is fitted on, at most


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    smoothing: float = 5.0
    patience: int = 15


@dataclass
class AdditiveModel:
    """score = logistic(base + one table value per feature + one per chosen pair of features)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, j], side="left")]
        for (i, j), values in self.pairs.items():
            out += values[np.searchsorted(self.pair_edges[i], x[:, i], side="left"),
                          np.searchsorted(self.pair_edges[j], x[:, j], side="left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles, each moved half way to the next larger value, so that no bin starts right at a common value."""
    if not len(column):
        return np.zeros(0)
    ordered = np.unique(column)
    at = np.searchsorted(ordered, np.quantile(column, np.arange(1, bins) / bins), side="right")
    at = np.unique(at[at < len(ordered)])
    return (ordered[at - 1] + ordered[at]) / 2


def _cut(g: np.ndarray, h: np.ndarray, smoothing: float) -> tuple[float, int]:
    """Best gain of one cut between neighbouring bins and the bin before it."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + smoothing) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + smoothing)
    at = int(gain.argmax())
    return float(gain[at] - g.sum() ** 2 / (h.sum() + smoothing)), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, smoothing: float) -> np.ndarray:
    """Leaf values per bin of a tree with two levels of cuts."""
    _, middle = _cut(g, h, smoothing)
    borders = {0, middle, len(g)}
    for a, b in ((0, middle), (middle, len(g))):
        gain, at = _cut(g[a:b], h[a:b], smoothing)
        if gain > 0:
            borders.add(a + at)
    out, ordered = np.zeros(len(g)), sorted(borders)
    for a, b in zip(ordered, ordered[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + smoothing)
    return out


def _square_tree(g: np.ndarray, h: np.ndarray, smoothing: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts, one on each axis."""
    low_g, low_h = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best = (-1.0, np.zeros(g.shape))
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            corners = lambda low: np.array([
                low[a - 1, b - 1], low[a - 1, -1] - low[a - 1, b - 1], low[-1, b - 1] - low[a - 1, b - 1],
                low[-1, -1] - low[a - 1, -1] - low[-1, b - 1] + low[a - 1, b - 1]])
            value = corners(low_g) / (corners(low_h) + smoothing)
            gain = float((corners(low_g) * value).sum())
            if gain > best[0]:
                leaves = np.empty(g.shape)
                leaves[:a, :b], leaves[:a, b:], leaves[a:, :b], leaves[a:, b:] = value
                best = (gain, leaves)
    return best


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean()) if len(y) else 0.0


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> AdditiveModel:
    """Cyclic boosting: in each round every feature's table takes one small step by a shallow tree.

    Afterwards the pairs of features with the largest gain on what is left are
    boosted likewise.  A tenth of the rows stops both loops.  Without rows of
    both classes the model is constant.
    """
    y = y.astype(float)
    width = x.shape[1]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [_edges(x[:, j], settings.bins) for j in range(width)]
    coarse = [_edges(x[:, j], settings.pair_bins) for j in range(width)]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges], coarse, {})
    if not 0 < y.sum() < len(y):
        return model
    judge = np.arange(len(y)) % 10 == 9
    learn = ~judge
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    margin = np.full(len(y), base)

    def gradients():
        p = _logistic(margin)
        return np.where(learn, y - p, 0.0), np.where(learn, p * (1 - p), 0.0)

    def boost(rounds: int, step) -> None:
        best, waited = _loss(margin[judge], y[judge]), 0
        for _ in range(rounds):
            step()
            now = _loss(margin[judge], y[judge])
            best, waited = (now, 0) if now < best - 1e-6 else (best, waited + 1)
            if waited >= settings.patience:
                break

    def each_feature() -> None:
        for j, at in enumerate(binned):
            g, h = gradients()
            n = len(model.tables[j])
            values = settings.rate * _shallow_tree(np.bincount(at, g, n), np.bincount(at, h, n), settings.smoothing)
            model.tables[j] += values
            margin[:] += values[at]

    boost(settings.rounds, each_feature)
    small = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = gradients()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = small[i] * shape[1] + small[j]
        grid = lambda v: np.bincount(at, v, shape[0] * shape[1]).reshape(shape)
        return _square_tree(grid(g), grid(h), settings.smoothing)

    gains = sorted(((sums(i, j)[0], i, j) for i, j in combinations(range(width), 2)), reverse=True)
    for _, i, j in gains[: settings.pairs]:
        model.pairs[i, j] = np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))

    def each_pair() -> None:
        for (i, j), values in model.pairs.items():
            step = settings.rate * sums(i, j)[1]
            values += step
            margin[:] += step[small[i], small[j]]

    boost(settings.pair_rounds, each_pair)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, settings: Settings = Settings()) -> AdditiveModel:
    """Fit on at most ``most`` labelled rows outside the held-out fold, features from whole texts alone."""
    sample = text_counts(labelled_sample(docs, labels, label, most), ["doc_id", "label"])
    names = list(ratios())
    rows = sample.select("label", *[e.cast("double").alias(n) for n, e in ratios().items()]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([[r[n] for n in names] for r in rows]).reshape(len(rows), len(names))
    return fit(x, np.array([r["label"] for r in rows], float), settings)


def score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text, from 0 to 1.

    Bins are found and table values added for many rows at once.  Defined
    cases: null and empty texts are scored as texts without words; repeated
    rows score alike; a clashing name gets a leading underscore; an empty
    table gives an empty table.  The model is a few small tables, whatever the
    size of the corpus.
    """
    added = fresh(docs, name)[0]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            counts = [counts_of(t or b"") for at in range(0, len(texts), ROWS_AT_ONCE)
                      for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()]
            found = model.score(ratio_matrix(np.array(counts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, added])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(added, T.DoubleType())]))
