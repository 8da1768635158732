"""Properties, and signals planted for the solvers to find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorasift.functions import geo
from agorasift.operators import anomalies as A
from agorasift.operators import communities as K
from agorasift.operators import graph as G
from agorasift.operators import labels as L
from agorasift.operators import model as M
from agorasift.operators import place as P
from agorasift.operators import ranking as R
from agorasift.operators import scores as S
from agorasift.operators import topics as X
from agorasift.operators import vocabulary as W


def components_by_hand(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_weak_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a long chain
    edges += [(5000, 6000 + i) for i in range(200)] + [(7, 7)]  # a hub and a loop
    rng.shuffle(edges)
    found = {r.node: r.component for r in G.weak_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == components_by_hand(edges)


def strong_by_hand(edges):
    reach = {n: {n} for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in reach:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    changed = True
    return {a: min(b for b in reach[a] if a in reach[b]) for a in reach}


def strong_found(spark, edges):
    return {r.node: r.component for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}


@pytest.mark.parametrize("seed, nodes, links", [(6, 60, 66), (8, 25, 60)])
def test_strong_components_match_reachability(spark, seed, nodes, links):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
    edges += [(100 + i, 100 + (i + 1) % 9) for i in range(9)]  # a ring without an exit, and a way into it
    edges += [(90, 95), (95, 104), (0, 90)]
    edges += [(200 + i, 201 + i) for i in range(7)] + [(207, 203), (207, 1), (2, 205), (209, 200)]  # a chain that comes back
    assert strong_found(spark, edges) == strong_by_hand(edges)


def test_strong_components_of_chains_take_few_jobs(spark):
    jobs = {}
    for n in (50, 200):
        ring, path = [(i, (i + 1) % n) for i in range(n)] + [(0, 5000)], [(1000 + i, 1001 + i) for i in range(n)]
        spark.sparkContext.setJobGroup(f"chain-{n}", "chain")
        found = strong_found(spark, ring + path)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))
        assert all(found[i] == 0 for i in range(n)) and all(found[1000 + i] == 1000 + i for i in range(n + 1)) and found[5000] == 5000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[200] < 1.6 * jobs[50]


def test_two_blocks_are_found(spark):
    rng = random.Random(1)
    edges = [(a, b, 1) for base in (0, 100) for a in range(base, base + 20) for b in range(base, base + 20)
             if a < b and rng.random() < 0.5] + [(0, 100, 1)]
    rows = K.communities(spark.createDataFrame(edges, "src long, dst long, weight long")).collect()
    top = max(r.level for r in rows)
    last = {r.node: r.community for r in rows if r.level == top}
    assert len({last[n] for n in range(20)}) == 1 and len({last[n] for n in range(100, 120)}) == 1
    assert last[0] != last[100]


def test_outlier_is_anomalous(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(600, 2)))] + [(9999, 12.0, -12.0)]
    scored = A.isolation_scores(spark.createDataFrame(rows, "user_id long, a double, b double"), trees=60, sample=128)
    found = {r.user_id: r.score for r in scored.collect()}
    assert found[9999] < 0 and found[9999] == min(found.values())
    assert np.median(list(found.values())) > 0
    again = A.isolation_scores(spark.createDataFrame(rows[::-1], "user_id long, a double, b double"), trees=60, sample=128)
    assert {r.user_id: r.score for r in again.collect()} == found


def two_topic_cells(spark):
    rng = random.Random(2)
    cells = [(d, (d % 2) * 10 + rng.randrange(10)) for d in range(60) for _ in range(30)]
    return spark.createDataFrame(cells, "row_id long, token_id long").groupBy("row_id", "token_id").agg(
        F.count(F.lit(1)).cast("double").alias("value"))


def separates(shares):
    best = {r.row_id: max(range(2), key=lambda i: r[f"topic_{i}"]) for r in shares}
    even, odd = {best[d] for d in best if d % 2 == 0}, {best[d] for d in best if d % 2 == 1}
    return len(even) == 1 and len(odd) == 1 and even != odd


def test_nmf_separates_topics(spark):
    w, h = X.fit_nmf(two_topic_cells(spark), 2)
    assert separates(X.factor_shares(w, "row_id", "w", 2).collect())
    assert h.count() == 20
    moved = X.nmf_transform(two_topic_cells(spark), h, 2)
    assert separates(X.factor_shares(moved, "row_id", "w", 2).collect())


def test_lda_separates_topics(spark):
    cells = two_topic_cells(spark)
    model = X.fit_lda(cells, 2, passes=30)
    rows = X.lda_doc_topics(model, cells, least=0.0).groupBy("row_id").pivot("topic", [0, 1]).sum("share")
    assert separates(rows.withColumnsRenamed({"0": "topic_0", "1": "topic_1"}).collect())


def labelled_cells(spark):
    rng = random.Random(4)
    cells = [(i, (i % 3) * 5 + rng.randrange(5), 1.0) for i in range(150) for _ in range(6)] + [(i, 15, -1.0) for i in range(0, 150, 2)]
    cells = spark.createDataFrame(cells, "row_id long, feature_id long, value double").groupBy("row_id", "feature_id").agg(
        F.sum("value").alias("value"))
    names = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("row_id") % 3 + 1).cast("int"))
    rows = spark.range(151).select(F.col("id").alias("row_id"))
    return cells, rows.withColumn("label", F.when((F.col("row_id") % 5 != 0) & (F.col("row_id") < 150), names))


def test_classifier_recovers_classes(spark, tmp_path):
    cells, labels = labelled_cells(spark)
    classifier = M.BoostedClassifier(rounds=5, depth=2, step=0.3).fit(cells, labels)
    rows = classifier.predict(cells, labels).collect()
    assert len(rows) == 151
    assert all(abs(r.p_0 + r.p_1 + r.p_2 - 1) < 1e-9 for r in rows)
    assert np.mean([r.predicted_class == "abc"[r.row_id % 3] for r in rows if r.row_id < 150]) > 0.9
    classifier.calibrate(cells, labels)
    found = {r.row_id: tuple(r) for r in classifier.predict(cells, labels).collect()}
    assert all(abs(sum(r[2:5]) - 1) < 1e-9 for r in found.values())
    names = spark.range(16).select(F.col("id").alias("feature_id"))
    assert abs(classifier.importances(names).agg(F.sum("importance")).first()[0] - 1) < 1e-6
    classifier.save(spark, str(tmp_path / "model"), features=names)
    again = M.BoostedClassifier.load(spark, str(tmp_path / "model"))
    assert again.classes == ["a", "b", "c"] and {r.row_id: tuple(r) for r in again.predict(cells, labels).collect()} == found


def test_split_is_the_best_of_all_columns(spark):
    """The first split of a tree against all cuts tried in plain Python, negative values and gaps included."""
    rng = random.Random(9)
    rows = [(i, {f: rng.choice([-2.0, -1.0, 1.0, 2.0]) for f in range(40) if rng.random() < 0.4}) for i in range(120)]
    label = lambda v: "x" if v.get(7, 0.0) > -1.5 else "y"
    cells = spark.createDataFrame([(i, f, x) for i, v in rows for f, x in v.items()], "row_id long, feature_id long, value double")
    labels = spark.createDataFrame([(i, label(v)) for i, v in rows], "row_id long, label string")
    model = M.BoostedClassifier(rounds=1, depth=1, validation_share=0.0).fit(cells, labels)
    assert {(s.feature, s.cut) for s in model.splits} == {(7, -2.0)}
    assert all(r.predicted_class == r.label for r in model.predict(cells, labels).collect())


def test_cross_validation_reports(spark):
    reports = M.cross_validate(*labelled_cells(spark), lambda: M.BoostedClassifier(rounds=3, depth=2), folds=2)
    assert {r.fold for r in reports.where(F.col("class") == "accuracy").collect()} == {0, 1}
    assert reports.agg(F.min("f1")).first()[0] > 0.5


def test_polygons_match_boxes(spark):
    points = spark.range(2000).select("id", (F.col("id") * 7919 % 180 - 89.5).alias("lat"), (F.col("id") * 104729 % 360 - 179.5).alias("lon"))
    boxes = spark.createDataFrame([("w", -40.0, 40.0, -100.0, 0.0), ("e", -40.0, 40.0, 0.0, 100.0)], "name string, lat0 double, lat1 double, lon0 double, lon1 double")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = boxes.select("name", F.array(corner("lon0", "lat0"), corner("lon1", "lat0"), corner("lon1", "lat1"), corner("lon0", "lat1")).alias("ring"))
    by_box = sorted((r.id, r.name) for r in P.join_boxes(points, boxes).collect())
    by_ring = sorted((r.id, r.name) for r in P.join_polygons(points, rings).collect())
    assert by_box == by_ring and len(by_box) > 100


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=997)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 4.0)], "g string, v double")
    found = {(r.g, r.share): r.value for r in R.exact_quantiles(df, "v", [0.1, 0.5, 1.0], within=["g"]).collect()}
    for q in (0.1, 0.5, 1.0):
        assert abs(found[("a", q)] - np.quantile(values, q)) < 1e-9
    assert found[("b", 0.5)] == 2.5


def test_encoders_and_scorers(spark):
    posts = spark.createDataFrame([(1, "aa"), (1, "bbbb"), (2, "@me c")], "user_id long, text string")
    rows = spark.createDataFrame([(1, 0), (2, 1)], "user_id long, row_id long")
    make = lambda: (lambda texts: [[len(x), 1.0] for x in texts])
    found = {r.user_id: (r.row_id, r.embedding) for r in W.user_embeddings(posts, make, rows).collect()}
    assert found == {1: (0, [3.0, 1.0]), 2: (1, [5.0, 1.0])}
    scorer = lambda: (lambda texts: [[float("@user" in x), 0.0, 0.0, 0.0] for x in texts])
    assert {r.user_id: r.anger for r in P.score_texts(posts, scorer).collect()}[2] == 1.0


def test_matrix_rows_sum_to_token_counts(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "z", 9)], "user_id long, token string, frequency long")
    vocabulary = W.relevant_vocabulary(counts.groupBy("token").agg(F.sum("frequency").alias("frequency")), 1, ["z"])
    rows = spark.createDataFrame([(1, 0), (2, 1)], "user_id long, row_id long")
    sums = W.term_matrix(counts, vocabulary, rows).groupBy("row_id").agg(F.sum("value").alias("s"))
    assert {r.row_id: r.s for r in sums.collect()} == {0: 5, 1: 1}


def test_log_odds_sign(spark):
    vectors = spark.createDataFrame([("x", 0, 50.0), ("y", 0, 1.0), ("y", 1, 40.0), ("x", 2, 5.0), ("y", 2, 5.0)], "predicted_class string, feature_id long, value double")
    found = {(r["class"], r.feature_id): r.score for r in S.log_odds(vectors, ["x", "y"]).collect()}
    assert found[("x", 0)] > 2 and found[("y", 1)] > 0 and found[("x", 1)] < 0
    assert abs(found[("x", 0)] + found[("y", 0)]) < 1e-9


def test_forest_sees_a_small_component(spark):
    """Members of a rare component stand out by it alone, without a column of its own."""
    rng = np.random.default_rng(3)
    rows = [(i, float(x), 1 << 60 if i < 3 else 7) for i, x in enumerate(rng.normal(size=400))]
    scored = A.isolation_scores(spark.createDataFrame(rows, "user_id long, a double, c long"), trees=60, sample=128, categories=["c"])
    found = {r.user_id: r.score for r in scored.collect()}
    assert np.mean([found[i] for i in range(3)]) < np.median([found[i] for i in range(3, 400)])
