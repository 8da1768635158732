"""Boosting and factorisation on blocks: the same on one block and on many, and right by plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorasift.operators import factors, histograms as H, model as M
from agorasift.operators.durable import durable


@pytest.fixture(scope="module")
def table(spark):
    value = (F.pmod(F.xxhash64("row_id", "feature_id"), F.lit(13)) - 3).cast("double")
    cells = spark.range(300).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("feature_id"))
    cells = durable(cells.where("pmod(xxhash64(row_id, feature_id, 1), 3) = 0 OR feature_id = 3").withColumn("value", value))
    own = cells.where("feature_id = 3").select("row_id", "value")
    labels = own.select("row_id", F.expr("CASE WHEN value > 4 THEN 'x' WHEN value < -1 THEN 'y' WHEN row_id % 10 < 8 THEN 'z' END").alias("label"))
    return cells, durable(labels)


def test_many_blocks_grow_the_trees_of_one(spark, table, monkeypatch):
    cells, labels = table
    settings = dict(rounds=5, depth=3, subsample=0.8, max_delta_step=2.0)
    one = M.BoostedClassifier(**settings).fit(cells, labels)
    whole = H.fit
    monkeypatch.setattr(H, "fit", lambda *given: whole(*given, block_cells=400))
    monkeypatch.setattr(H, "RANGE_FEATURES", 7)
    monkeypatch.setattr(H.ManyBlocks, "rewritten_after", 2)
    many = M.BoostedClassifier(**settings).fit(cells, labels)
    assert one.splits and len(one.leaves) == len(many.leaves)
    told = lambda c: [(s.turn, s.code, s.node, s.feature, s.cut, round(s.gain, 6)) for s in c.splits]
    assert told(one) == told(many)
    assert all(abs(a.value - b.value) < 1e-9 for a, b in zip(one.leaves, many.leaves, strict=True))
    right = one.predict(cells, labels.where("label IS NOT NULL")).select((F.col("label") == F.col("predicted_class")).cast("int").alias("r"))
    assert right.agg(F.avg("r")).first()[0] > 0.95


def test_best_split_against_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(40):
        values = rng.integers(-3, 4, (30, 5))  # bins; zero is a missing cell
        g, h = rng.normal(size=30), rng.uniform(0.05, 0.25, 30)
        row, feature = np.nonzero(values)
        keys, at = np.unique(feature * H.SLOTS + values[row, feature] + H.ZERO, return_inverse=True)
        sums = [np.bincount(at, x[row], len(keys)) for x in (g, h)]
        got = H.best_split(keys, *sums, np.array([g.sum(), h.sum()]), 1.0)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        every = [(round(score(values[:, f] >= t) + score(values[:, f] < t) - score(np.full(30, True)), 9), -f, t)
                 for f in range(5) for t in range(-2, 4) if (values[:, f] >= t).any() and (values[:, f] < t).any()]
        best = max(every)
        assert got[2] == pytest.approx(best[0], abs=1e-8)
        f, t = got[0], got[1]
        assert got[3] == pytest.approx(g[values[:, f] >= t].sum()) and got[4] == pytest.approx(h[values[:, f] >= t].sum())


def test_no_validation_rows_and_no_gain(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "row_id long, label string")
    cells = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)], "row_id long, feature_id long, value double")
    fitted = M.BoostedClassifier(rounds=3).fit(cells, labels)
    assert not fitted.splits
    assert fitted.predict(cells, labels).count() == 3
    empty = M.BoostedClassifier(rounds=3).fit(cells, labels.where("label IS NULL"))
    assert empty.classes == [] and not empty.leaves


def matrix(spark, rows, columns, rank, seed=1):
    rng = np.random.default_rng(seed)
    full = rng.random((rows, rank)) ** 3 @ rng.random((rank, columns)) ** 3
    full[full < np.median(full)] = 0
    r, c = np.nonzero(full)
    cells = spark.createDataFrame([(int(a), f"t{b}", float(full[a, b])) for a, b in zip(r, c)], "row_id long, token_id string, value double")
    return durable(cells), full


def dense(df, key, name, k, order):
    of = {r[0]: r[1:] for r in df.select(key, *[f"{name}{i}" for i in range(k)]).collect()}
    return np.array([of.get(o, (0.0,) * k) for o in order], float)  # rows of zeros have no factor


def test_factors_on_a_grid_are_those_of_one_block(spark):
    cells, full = matrix(spark, 60, 40, 3)
    names = [f"t{b}" for b in range(40)]
    errors = []
    for settings in ({}, {"grid_cells": 300, "block_rows": 25}):
        w, h = factors.fit_nmf(cells, 3, tolerance=1e-3, **settings)
        w, h = dense(w, "row_id", "w", 3, range(60)), dense(h, "token_id", "h", 3, names)
        assert (w >= 0).all() and (h >= 0).all()
        errors.append((np.linalg.norm(full - w @ h.T), w @ h.T))
    assert errors[0][0] < 0.5 * np.linalg.norm(full)
    assert errors[1][0] == pytest.approx(errors[0][0], rel=1e-6) and np.allclose(errors[0][1], errors[1][1], atol=1e-6)


def test_no_multiplicative_update_lowers_the_error_much(spark):
    """As good as numpy after a thousand multiplicative updates."""
    cells, full = matrix(spark, 50, 30, 4, seed=2)
    w, h = factors.fit_nmf(cells, 4)
    got = np.linalg.norm(full - dense(w, "row_id", "w", 4, range(50)) @ dense(h, "token_id", "h", 4, [f"t{b}" for b in range(30)]).T)
    rng = np.random.default_rng(0)
    a, b = rng.random((50, 4)), rng.random((4, 30))
    for _ in range(1000):
        b *= (a.T @ full) / (a.T @ a @ b + 1e-12)
        a *= (full @ b.T) / (a @ b @ b.T + 1e-12)
    assert got < 1.05 * np.linalg.norm(full - a @ b)


def test_transform_solves_each_row(spark):
    cells, full = matrix(spark, 40, 30, 3, seed=3)
    _, h = factors.fit_nmf(cells, 3)
    basis = dense(h, "token_id", "h", 3, [f"t{b}" for b in range(30)])
    w = dense(factors.nmf_transform(cells, h, 3), "row_id", "w", 3, range(40))
    slope = w @ basis.T @ basis - full @ basis  # zero where w is positive, not negative elsewhere
    assert (w >= 0).all() and np.abs(slope[w > 0]).max() < 1e-6 and slope[w == 0].min(initial=0) > -1e-6
    none = factors.fit_nmf(cells.limit(0), 3)
    assert none[0].count() == none[1].count() == 0
