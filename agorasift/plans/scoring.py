"""Queries around classifiers, and over candidate selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorasift.operators import annotate as A
from agorasift.operators import graph as G
from agorasift.operators import labels as L
from agorasift.operators import model as M
from agorasift.operators import scores as S
from agorasift.operators.durable import durable, scratch_path, stored
from agorasift.plans.labels import ALLOWED, CLASSES, FAMILIES, label_manual, model_features, user_features
from agorasift.plans.registry import query
from agorasift.sources import files

SCORES = {"p_alpha": "alpha", "p_beta": "beta"}
SHOWN = ("alpha", "beta", "noise", "undisclosed")

# labels of documents: the quality grade
_GRADED = "(SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS class FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def graded(t):
    grade = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", grade.alias("class"))


@query("label_encode", """
SELECT user_id, CAST(dense_rank() OVER (ORDER BY predicted_class) - 1 AS INTEGER) AS code FROM predictions""", ["predictions"])
def label_encode(t):
    return S.label_encode(t.predictions, "predicted_class")[0].select("user_id", "code")


@query("stratified_split", """
SELECT user_id, predicted_class, n - 1 < floor(total * 0.15 + 0.5) AS validation FROM (
  SELECT user_id, predicted_class, row_number() OVER (PARTITION BY predicted_class ORDER BY md5(concat(user_id, ':42')), user_id) AS n,
         count(*) OVER (PARTITION BY predicted_class) AS total FROM two_classes)""", ["two_classes"])
def stratified_split(t):
    rows = t.two_classes.select("user_id", "predicted_class")
    return S.stratified_split(rows, 0.15, "predicted_class")


@query("balanced_weights", """
SELECT user_id, predicted_class, round((SELECT count(*) FROM predictions) / ((SELECT count(DISTINCT predicted_class) FROM predictions)
  * CAST(count(*) OVER (PARTITION BY predicted_class) AS DOUBLE)), 6) AS weight FROM predictions""", ["predictions"])
def balanced_weights(t):
    weighted = S.balanced_weights(t.predictions, "predicted_class")
    return weighted.select("user_id", "predicted_class", F.round("weight", 6).alias("weight"))


_ARGMAX = "CASE WHEN p_alpha >= p_beta THEN 'alpha' ELSE 'beta' END"


@query("argmax_class", f"SELECT user_id, {_ARGMAX} AS predicted_class FROM scores", ["scores"])
def argmax_class(t):
    return S.argmax_class(t.scores, SCORES).select("user_id", "predicted_class")


@query("threshold_class", f"""
SELECT user_id, CASE WHEN greatest(p_alpha, p_beta) < 0.6 THEN 'undisclosed' ELSE {_ARGMAX} END AS predicted_class
FROM scores""", ["scores"])
def threshold_class(t):
    return S.threshold_class(S.argmax_class(t.scores, SCORES), SCORES, 0.1).select("user_id", "predicted_class")


@query("preserve_labels", f"""
SELECT s.user_id, coalesce(k.class, {_ARGMAX}) AS predicted_class FROM scores s
LEFT JOIN known_accounts k ON k.user_id = s.user_id""", ["scores", "known_accounts"])
def preserve_labels(t):
    known = t.known_accounts.withColumnRenamed("class", "reported_label")
    predicted = S.argmax_class(t.scores.join(known, "user_id", "left"), SCORES)
    return S.preserve_labels(predicted).select("user_id", "predicted_class")


@query("allowlist_class", """
SELECT user_id, CASE WHEN user_id IN (17, 34, 1) AND predicted_class = 'noise' THEN 'alpha' ELSE predicted_class END
  AS predicted_class FROM predictions""", ["predictions"])
def allowlist_class(t):
    return S.allow_accounts(t.predictions, (17, 34, 1), "alpha").select("user_id", "predicted_class")


@query("class_distribution", """
SELECT predicted_class, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM predictions) AS DOUBLE), 6) AS share
FROM predictions GROUP BY 1""", ["predictions"])
def class_distribution(t):
    return S.class_distribution(t.predictions).withColumn("share", F.round("share", 6))


@query("label_min_probability", f"""
SELECT user_id, round(greatest(p_alpha, p_beta), 6) AS max_probability,
       CASE WHEN greatest(p_alpha, p_beta) < 0.7 THEN NULL ELSE {_ARGMAX} END AS label, 'model' AS source FROM scores""", ["scores"])
def label_min_probability(t):
    labelled = S.label_min_probability(t.scores, SCORES, 0.7)
    return labelled.select("user_id", F.round("max_probability", 6).alias("max_probability"), "label", "source")


def class_vectors(t):
    """Feature sums of each class, from cells of the classes; classes are stored, so that their size is known."""
    classes = stored(t.predictions.select(F.col("user_id").alias("row_id"), "predicted_class"), "classes")
    named = classes.select(F.col("predicted_class").alias("row_id"), "predicted_class").distinct()
    return S.group_vectors(user_features(t, groups=classes), named, ["type", "token"])


@query("group_vectors", """
SELECT p.predicted_class, f.type, f.token, sum(f.value) AS value FROM features f
JOIN predictions p ON p.user_id = f.row_id GROUP BY 1, 2, 3""", ["features", "predictions"])
def group_vectors(t):
    return class_vectors(t)


_ODDS = """
WITH grid AS (
  SELECT c.class, f.type, f.token, sum(CASE WHEN p.predicted_class = c.class THEN f.value ELSE 0 END) AS y, sum(f.value) AS total
  FROM features f JOIN predictions p ON p.user_id = f.row_id, (VALUES ('alpha'), ('beta'), ('noise'), ('undisclosed')) c(class)
  GROUP BY 1, 2, 3),
sums AS (SELECT class, sum(y) AS n, sum(total) AS everything, 0.001 * count(*) AS a FROM grid GROUP BY 1),
odds AS (
  SELECT g.class, g.type, g.token, g.y + 0.001::DOUBLE AS own, g.total - g.y + 0.001::DOUBLE AS rest,
         s.n + s.a::DOUBLE AS own_mass, s.everything - s.n + s.a::DOUBLE AS rest_mass FROM grid g JOIN sums s USING (class)),
scored AS (
  SELECT class, type, token, (ln(own / (own_mass - own)) - ln(rest / (rest_mass - rest))) / sqrt(1 / own + 1 / rest) AS score FROM odds)
"""


def associations(t):
    return S.log_odds(stored(class_vectors(t)), SHOWN, ["type", "token"])


@query("log_odds", _ODDS + "SELECT class, type, token, round(score, 5) AS score FROM scored", ["features", "predictions"])
def log_odds(t):
    return associations(t).withColumn("score", F.round("score", 5))


@query("top_terms", _ODDS + """
SELECT class, type, token, round(score, 5) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(score, 8) DESC, type, token) AS n FROM scored
  WHERE type = 'description_token') WHERE n <= 15""", ["features", "predictions"])
def top_terms(t):
    rounded = associations(t).withColumn("score", F.round("score", 8))
    return S.top_terms(rounded, 15, family="description_token").withColumn("score", F.round("score", 5))


@query("kfold_assignment", f"""
SELECT doc_id, class, CAST((row_number() OVER (PARTITION BY coalesce(class, '__null__') ORDER BY md5(concat(doc_id, ':42')), doc_id) - 1) % 5
  AS INTEGER) AS fold FROM {_GRADED}""")
def kfold_assignment(t):
    return S.fold_assignment(graded(t), 5, "class", "doc_id")


_REPORT = f"""
WITH judged AS (SELECT reported AS label, {_ARGMAX} AS predicted FROM (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'alpha' WHEN user_id % 3 = 1 THEN 'beta' WHEN user_id % 5 = 0 THEN 'gamma' END AS reported, * FROM scores)
  WHERE reported IS NOT NULL),
classes AS (SELECT label AS class FROM judged UNION SELECT predicted FROM judged),
counts AS (
  SELECT c.class, count_if(j.label = c.class) AS support, count_if(j.predicted = c.class) AS named,
         count_if(j.label = c.class AND j.predicted = c.class) AS hits FROM classes c, judged j GROUP BY 1),
rates AS (
  SELECT class, support, hits, CASE WHEN named = 0 THEN 1 ELSE hits / named::DOUBLE END AS precision,
         CASE WHEN support = 0 THEN 1 ELSE hits / support::DOUBLE END AS recall, 2 * hits / (named + support)::DOUBLE AS f1 FROM counts),
report AS (
  SELECT class, support, precision, recall, f1 FROM rates
  UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM rates
  UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support) FROM rates
  UNION ALL SELECT 'accuracy', sum(support), sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support) FROM rates)
SELECT class, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report"""


@query("classification_report", _REPORT, ["scores"])
def classification_report(t):
    u = F.col("user_id")
    reported = F.when(u % 3 == 0, "alpha").when(u % 3 == 1, "beta").when(u % 5 == 0, "gamma")
    judged = S.argmax_class(t.scores, SCORES).withColumn("reported_label", reported)
    report = S.classification_report(judged)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# importances of the features, as if a model had given them
_IMPORTANCE = "CAST((length(token) * 7 + ascii(token)) % 23 AS DOUBLE) / 23"


def importances(t):
    value = ((F.length("token") * 7 + F.ascii("token")) % 23).cast("double") / 23
    return user_features(t, groups=F.lit("all")).select("type", "token").distinct().withColumn("importance", value)


_TITLES = """CASE type WHEN 'description_token' THEN 'bio' WHEN 'domain' THEN 'link' WHEN 'rt_target' THEN 'RT' WHEN 'reply_target' THEN 'REPLY'
  WHEN 'quote_target' THEN 'QUOTE' WHEN 'tweet_tokens' THEN 'term' WHEN 'user_name' THEN 'name' WHEN 'profile_domain' THEN 'bio.link'
  WHEN 'profile_tld' THEN 'bio.tld' END"""
_SHOWN_FEATURES = f"""
named AS (
  SELECT DISTINCT type AS family, token AS raw, {_IMPORTANCE} AS importance, {_TITLES} AS type,
    CASE WHEN type NOT LIKE '%_target' THEN token WHEN u.user_id IS NULL THEN concat('ID:', token) ELSE concat('@user', token) END AS token
  FROM features f LEFT JOIN users u ON f.type LIKE '%_target' AND CAST(u.user_id AS VARCHAR) = f.token)"""


@query("model_features", _ODDS + f""", {_SHOWN_FEATURES}
SELECT s.class, concat(s.type, ':', s.token) AS label, n.type, n.token, concat(n.type, ':', n.token) AS new_label,
       round(s.score, 5) AS score, round(n.importance, 6) AS importance
FROM scored s JOIN named n ON n.family = s.type AND n.raw = s.token WHERE n.importance > 0""", ["features", "predictions", "users"])
def model_feature_view(t):
    shown = S.model_features(associations(t), importances(t), screen_names(t))
    return shown.select("class", "label", "type", "token", "new_label", F.round("score", 5).alias("score"),
                        F.round("importance", 6).alias("importance"))


def screen_names(t):
    return t.users.select("user_id", F.concat(F.lit("user"), "user_id").alias("screen_name"))


@query("importance_by_type", f"""
SELECT type, count(*) AS n_features, round(avg({_IMPORTANCE}), 6) AS mean_importance FROM (
  SELECT DISTINCT type, token FROM features) GROUP BY type""", ["features"])
def importance_by_type(t):
    return S.importance_by_type(importances(t)).withColumn("mean_importance", F.round("mean_importance", 6))


@query("save_predictions", """
SELECT user_id, dataset_posts, reported_label, predicted_class, round(p_alpha, 6) AS p_alpha FROM predictions""", ["predictions"])
def save_predictions(t):
    path = scratch_path(t.spark, "predictions")
    files.write_parquet(t.predictions, path)
    return t.spark.read.parquet(path).select("user_id", "dataset_posts", "reported_label", "predicted_class",
                                             F.round("p_alpha", 6).alias("p_alpha"))


@query("proportion_cumsum", """
SELECT layer, src, round(sum(p) OVER w, 6) AS cumulative, round(sum(p) OVER w - p / 2, 6) AS midpoint FROM (
  SELECT layer, src, CAST(sum(weight) AS DOUBLE) / sum(sum(weight)) OVER (PARTITION BY src) AS p FROM edges GROUP BY 1, 2)
WINDOW w AS (PARTITION BY src ORDER BY layer ROWS UNBOUNDED PRECEDING)""", ["edges"])
def proportion_cumsum(t):
    from agorasift.operators.columns import normalize_rows

    shares = normalize_rows(t.edges.groupBy("src", "layer").agg(F.sum("weight").alias("value")), "src")
    marked = S.proportion_midpoints(shares, "src", "layer", "value")
    return marked.select("layer", "src", F.round("cumulative", 6).alias("cumulative"), F.round("midpoint", 6).alias("midpoint"))


# candidate selection

_POOL = """SELECT user_id, dataset_posts, p_alpha, predicted_class FROM predictions
WHERE reported_label IS NULL AND user_id NOT IN (SELECT user_id FROM ages WHERE predicted_class = 'noise')"""


def pool(t):
    annotated = t.ages.where(F.col("predicted_class") == "noise")
    return A.unlabeled_pool(t.users.select("user_id"), t.predictions, annotated).select(
        "user_id", "dataset_posts", "p_alpha", "predicted_class")


@query("unlabeled_pool", f"SELECT user_id, dataset_posts, predicted_class FROM ({_POOL})", ["predictions", "ages"])
def unlabeled_pool(t):
    return pool(t).drop("p_alpha")


@query("feature_accounts", """
SELECT user_id, dataset_posts FROM users WHERE CAST(user_id AS VARCHAR) IN (SELECT token FROM features WHERE type = 'rt_target')""",
       ["features", "users"])
def feature_accounts(t):
    targets = user_features(t, ("rt_target",)).select("token").distinct()
    return A.feature_accounts(t.users, targets.select(F.lit("RT").alias("type"), F.concat(F.lit("RT:"), "token").alias("label")))


@query("weak_candidates", f"""
WITH weak AS (SELECT * FROM ({_POOL}) WHERE p_alpha BETWEEN 0.3 AND 0.85 ORDER BY dataset_posts DESC, user_id LIMIT 1000)
SELECT user_id, dataset_posts FROM (SELECT * FROM weak WHERE (SELECT count(*) FROM weak) >= 5)
ORDER BY md5(concat(user_id, ':42')), user_id LIMIT 10""", ["predictions", "ages"])
def weak_candidates(t):
    return A.weak_candidates(pool(t), "p_alpha", 0.3, 0.85, least=5).select("user_id", "dataset_posts")


_CHOSEN_POSTS = """
SELECT id, CAST(date AS VARCHAR) AS date, user_id, md5(text) AS text_md5 FROM posts WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'
AND user_id IN (SELECT user_id FROM predictions WHERE predicted_class = 'noise')"""


def noise_posts(t, most=None, columns=("id", "date", "user_id", "text")):
    noise = t.predictions.where(F.col("predicted_class") == "noise")
    doubled = t.posts.unionByName(t.posts)
    return A.posts_of_users(doubled, noise, "2024-01-03", "2024-01-25", most, columns)


@query("posts_of_users", f"{_CHOSEN_POSTS} ORDER BY posts.date, id LIMIT 500", ["posts", "predictions"])
def posts_of_users(t):
    return noise_posts(t, 500).select("id", F.col("date").cast("string").alias("date"), "user_id", F.md5("text").alias("text_md5"))


@query("cross_group_edges", """
SELECT e.dst, CAST(sum(e.weight) AS BIGINT) AS weight FROM edges e JOIN predictions s ON s.user_id = e.src
LEFT JOIN predictions d ON d.user_id = e.dst
WHERE e.layer = 'retweet' AND s.predicted_class IS DISTINCT FROM d.predicted_class GROUP BY 1
ORDER BY weight DESC, dst LIMIT 1000""", ["edges", "predictions"])
def cross_group_edges(t):
    return A.cross_group_edges(t.edges.where(F.col("layer") == "retweet"), t.predictions)


@query("posts_sample_per_user", f"""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat(id, ':42')), id) AS n FROM ({_CHOSEN_POSTS}))
WHERE n <= 5""", ["posts", "predictions"])
def posts_sample_per_user(t):
    # chosen by their keys; only the texts of the sample are exchanged
    sampled = A.posts_sample_per_user(noise_posts(t, columns=("id", "date", "user_id")))
    found = sampled.select(F.col("id").alias("_id"))
    return noise_posts(t).join(found, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("id", F.col("date").cast("string").alias("date"), "user_id", F.md5("text").alias("text_md5"))


# classifiers

def training_rows(t):
    """Cells of all users over all features, their weak labels, the users, the dictionary; seeds are removed."""
    found = stored(user_features(t))
    features = stored(model_features(t, found))
    dictionary = durable(L.feature_dictionary(features, FAMILIES))
    cells = stored(L.feature_cells(features, dictionary))
    labels = durable(L.single_label(label_manual(t, found), CLASSES))
    return cells, labels, t.users.select(F.col("user_id").alias("row_id"), "user_id"), dictionary


def boosted_classifier():
    return M.BoostedClassifier()


@query("classifier_predictions")
def classifier_predictions(t):
    cells, labels, users, _ = training_rows(t)
    return M.classify(cells, labels, boosted_classifier(), users, ALLOWED).select(
        "user_id", "p_0", "p_1", "reported_label", "predicted_class")


@query("calibrated_predictions")
def calibrated_predictions(t):
    cells, labels, users, _ = training_rows(t)
    split = durable(S.stratified_split(labels, 0.2, "label", "row_id", seed=7))
    classifier = boosted_classifier().fit(cells, split.where(~F.col("validation")))
    classifier.calibrate(cells, split.where("validation"))
    return classifier.predict(cells, users.join(labels, "row_id", "left")).drop("user_id")


@query("feature_importance")
def feature_importance(t):
    cells, labels, _, dictionary = training_rows(t)
    return boosted_classifier().fit(cells, labels).importances(dictionary)


@query("cross_validation")
def cross_validation(t):
    cells, labels, users, _ = training_rows(t)
    return M.cross_validate(cells, users.join(labels, "row_id", "left"), boosted_classifier)


@query("stored_model", "SELECT user_id, true AS same FROM users", ["users"])
def stored_model(t):
    """A model written and read back gives the same probabilities."""
    cells, labels, users, dictionary = training_rows(t)
    classifier = boosted_classifier().fit(cells, labels)
    path = scratch_path(t.spark, "model")
    classifier.save(t.spark, path, features=dictionary, matrix=cells)
    again = M.BoostedClassifier.load(t.spark, path).predict(t.spark.read.parquet(f"{path}/matrix"), users)
    first = classifier.predict(cells, users).select("row_id", F.struct("p_0", "p_1", "predicted_class").alias("first"))
    return again.join(first, "row_id").select("user_id", F.struct("p_0", "p_1", "predicted_class").eqNullSafe(F.col("first")).alias("same"))
