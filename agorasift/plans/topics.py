"""Queries over topics, places and emotions."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorasift.functions import text as T
from agorasift.operators import columns as C
from agorasift.operators import consolidate
from agorasift.operators import daily
from agorasift.operators import labels as L
from agorasift.operators import place as P
from agorasift.operators import topics as X
from agorasift.operators import vocabulary as W
from agorasift.operators.durable import durable, stored
from agorasift.operators.ranking import number_rows
from agorasift.plans.analysis import _BASE, _CONSOLIDATED, consolidated, rounded
from agorasift.plans.days import user_tokens
from agorasift.plans.experiment import post_vocabulary
from agorasift.plans.registry import query

MIN_USERS, USERS_SHARE, POSTS_SHARE = 5, 0.9, 0.95
TOPICS = 8

_TOPIC = f"""{_CONSOLIDATED},
reached AS (SELECT token, CAST(sum(n) AS BIGINT) AS n_users FROM (
  SELECT p.predicted_class, w.token, w.date, count(DISTINCT w.user_id) AS n FROM post_words w
  JOIN predictions p ON p.user_id = w.user_id AND p.predicted_class <> 'noise' GROUP BY 1, 2, 3) GROUP BY 1),
known AS (SELECT v.token, v.token_id, r.n_users FROM post_vocab v JOIN reached r ON r.token = v.token),
topic_vocab AS (SELECT * FROM known WHERE n_users BETWEEN {MIN_USERS} AND (SELECT quantile_cont(n_users, {USERS_SHARE}) FROM known)),
topic_rows AS (SELECT user_id, user_id AS row_id, dataset_posts FROM consolidated WHERE dataset_posts BETWEEN 1 AND
  (SELECT quantile_cont(dataset_posts, {POSTS_SHARE}) FROM consolidated))"""
_TOPIC_VIEWS = list(dict.fromkeys([*_BASE, "post_words", "predictions", "post_vocab", "users", "user_tokens"]))


def user_day_tokens(t):
    return stored(user_tokens(t, ("user_id", "date")))


def topic_parts(t):
    words = user_day_tokens(t)
    vocabulary = durable(post_vocabulary(t, words))
    frequencies = consolidate.word_frequencies(words, t.predictions, "stance")
    chosen = durable(X.topic_vocabulary(vocabulary, frequencies, MIN_USERS, USERS_SHARE))
    rows = durable(chosen_users(t))
    return W.term_matrix(words, chosen, rows), rows, chosen


def chosen_users(t):
    users = durable(consolidated(t).select("user_id", F.col("user_id").alias("row_id"), "dataset_posts"))
    return X.topic_users(users, 1, POSTS_SHARE)


@query("topic_vocabulary", f"WITH {_TOPIC} SELECT token, token_id, n_users FROM topic_vocab", _TOPIC_VIEWS)
def topic_vocabulary(t):
    return topic_parts(t)[2].select("token", "token_id", "n_users")


@query("topic_users", f"WITH {_TOPIC} SELECT user_id, dataset_posts FROM topic_rows", _TOPIC_VIEWS)
def topic_users(t):
    return chosen_users(t).select("user_id", "dataset_posts")


@query("topic_matrix", f"""
WITH {_TOPIC}, r AS (SELECT user_id, row_number() OVER (ORDER BY row_id) - 1 AS doc_id FROM topic_rows),
c AS (SELECT token, row_number() OVER (ORDER BY token_id) - 1 AS term_id FROM topic_vocab)
SELECT r.doc_id, c.term_id, w.frequency AS value FROM user_tokens w JOIN r ON r.user_id = w.user_id JOIN c ON c.token = w.token""",
       _TOPIC_VIEWS)
def topic_matrix(t):
    return X.topic_matrix(*topic_parts(t))


def fitted_lda(t):
    matrix, _, vocabulary = topic_parts(t)
    terms = durable(number_rows(vocabulary.select("token", "token_id"), [F.col("token_id")], "term_id"))
    cells = durable(matrix.join(terms.select("token_id", "term_id"), "token_id").select("row_id", "term_id", "value"))
    return X.fit_lda(cells, TOPICS, concentration=X.asymmetric_concentration(TOPICS), column="term_id"), cells, terms


@query("lda_topics")
def lda_topics(t):
    model, _, terms = fitted_lda(t)
    return X.lda_topic_terms(model, terms).select("topic", F.col("position").cast("int").alias("position"), "weight")


@query("lda_topic_terms")
def lda_topic_terms(t):
    model, _, terms = fitted_lda(t)
    return X.lda_topic_terms(model, terms).select("term_id", "topic", "position", "weight", "token")


@query("lda_doc_topics")
def lda_doc_topics(t):
    model, cells, _ = fitted_lda(t)
    return X.lda_doc_topics(model, cells)


# places: documents and posts get a point each

@query("daily_counts", """
SELECT CAST(d AS VARCHAR) AS date, coalesce(n, 0) AS n_posts FROM (
  SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS d)
LEFT JOIN (SELECT date, count(*) AS n FROM posts GROUP BY 1) c ON c.date = d""", ["posts"])
def daily_counts(t):
    return P.daily_counts(t.posts, "2023-12-25", "2024-02-05").withColumn("date", F.col("date").cast("string"))


_VOCAB = """
counted AS (SELECT token, count(*) AS frequency FROM doc_words GROUP BY 1),
vocab AS (SELECT * FROM counted WHERE frequency BETWEEN 5 AND (SELECT quantile_cont(frequency, 0.985) FROM counted))"""


def document_vocabulary(t):
    return W.between_quantile(daily.token_frequency(t.documents, T.tokenize, text="text"), "frequency", 5, 0.985)


@query("vocabulary_quantile", f"WITH {_VOCAB} SELECT token, frequency FROM vocab", ["doc_words"])
def vocabulary_quantile(t):
    return document_vocabulary(t)


_INSIDE = "b.lat0 <= c.lat AND c.lat < b.lat1 AND b.lon0 <= c.lon AND c.lon < b.lon1"


def placed_points(t):
    return P.join_boxes(t.coords, t.boxes)


@query("place_join", f"SELECT c.id, round(c.lat, 6) AS lat, round(c.lon, 6) AS lon, b.name FROM coords c JOIN boxes b ON {_INSIDE}",
       ["coords", "boxes"])
def place_join(t):
    return rounded(placed_points(t))


@query("polygon_join", """
SELECT id, CASE WHEN lat > lon / 2 THEN 'north' ELSE 'south' END AS name FROM (
  SELECT id, lat + 0.003 AS lat, lon + 0.001 AS lon FROM coords)
WHERE (lat > lon / 2 AND lat < 85 AND lon > -170) OR (lat < lon / 2 AND lat > -85 AND lon < 170)""", ["coords"])
def polygon_join(t):
    # two triangles that share the long side of lat = lon / 2
    points = t.coords.withColumns({"lat": F.col("lat") + 0.003, "lon": F.col("lon") + 0.001})
    rings = t.spark.createDataFrame(
        [("north", [(-170.0, -85.0), (170.0, 85.0), (-170.0, 85.0)]), ("south", [(-170.0, -85.0), (170.0, 85.0), (170.0, -85.0)])],
        "name string, ring array<struct<x: double, y: double>>")
    return P.join_polygons(points, rings, size=30.0).select("id", "name")


@query("place_counts", f"SELECT b.name, count(*) AS n_posts FROM coords c JOIN boxes b ON {_INSIDE} GROUP BY 1", ["coords", "boxes"])
def place_counts(t):
    return P.place_counts(placed_points(t))


@query("bbox_clip", """
SELECT id FROM coords WHERE lat BETWEEN -30.5 AND 40.5 AND lon BETWEEN -100.5 AND 60.5""", ["coords"])
def bbox_clip(t):
    return P.bbox_clip(t.coords, -30, 40, -100, 60, buffer=0.5).select("id")


def document_cells(t):
    """Token counts of each document over the middle vocabulary."""
    words = stored(daily.user_token_frequency(t.documents, T.tokenize, ["doc_id"], "text"))
    totals = words.groupBy("token").agg(F.sum("frequency").alias("frequency"))
    chosen = W.between_quantile(totals, "frequency", 5, 0.985)
    return words.withColumnRenamed("frequency", "value").join(chosen.select("token"), "token", "left_semi")


def document_places(t):
    documents = t.documents.select((F.col("doc_id") + 1).alias("id"))
    return placed_points(t).join(documents, "id", "left_semi").select((F.col("id") - 1).alias("doc_id"), "name")


_CELLS = f"""
{_VOCAB},
cells AS (SELECT w.doc_id, w.token, CAST(count(*) AS DOUBLE) AS value FROM doc_words w JOIN vocab v ON v.token = w.token GROUP BY 1, 2),
idf AS (SELECT token, ln((1.0 + (SELECT count(DISTINCT doc_id) FROM cells)) / (1.0 + count(*))) + 1 AS idf FROM cells GROUP BY 1),
weighted AS (SELECT doc_id, token, value * idf / sqrt(sum(value * idf * value * idf) OVER (PARTITION BY doc_id)) AS value
             FROM cells JOIN idf USING (token))"""
_PLACES = f"""
places AS (SELECT c.id - 1 AS doc_id, b.name FROM coords c JOIN boxes b ON {_INSIDE}),
sums AS (SELECT p.name, c.token, sum(c.value) AS value FROM cells c JOIN places p ON p.doc_id = c.doc_id GROUP BY 1, 2),
place_weights AS (SELECT name, token, value * idf / sqrt(sum(value * idf * value * idf) OVER (PARTITION BY name)) AS value
                  FROM sums JOIN idf USING (token))"""


@query("tfidf_l2", f"WITH {_CELLS} SELECT doc_id, token, round(value, 6) AS value FROM weighted", ["doc_words"])
def tfidf_l2(t):
    return rounded(L.tfidf(stored(document_cells(t)), row="doc_id", column="token").select("doc_id", "token", "value"))


@query("term_importance", f"WITH {_CELLS} SELECT token, round(sum(value), 5) AS importance FROM weighted GROUP BY 1", ["doc_words"])
def term_importance(t):
    weighted = L.tfidf(stored(document_cells(t)), row="doc_id", column="token")
    return P.term_importance(weighted).withColumn("importance", F.round("importance", 5))


def weighted_places(t):
    cells = stored(document_cells(t))
    rows = cells.select("doc_id").distinct().count()
    return P.place_terms(cells, document_places(t), rows, row="doc_id"), cells


@query("place_terms", f"WITH {_CELLS}, {_PLACES} SELECT name, token, round(value, 6) AS value FROM place_weights",
       ["doc_words", "coords", "boxes"])
def place_terms(t):
    return rounded(weighted_places(t)[0].select("name", "token", "value"))


@query("place_top_terms", f"""
WITH {_CELLS}, {_PLACES} SELECT name, token, round(value, 5) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(value, 9) DESC, token) AS n FROM place_weights) WHERE n <= 10""",
       ["doc_words", "coords", "boxes"])
def place_top_terms(t):
    weighted = weighted_places(t)[0].select("name", "token", F.round("value", 9).alias("value"))
    return P.place_top_terms(weighted).withColumn("value", F.round("value", 5))


def fitted_nmf(t):
    weighted, cells = weighted_places(t)
    posts = L.tfidf(cells, row="doc_id", column="token")
    w, h = X.fit_nmf(posts, TOPICS, row="doc_id", column="token")
    return weighted, h


@query("nmf_topics")
def nmf_topics(t):
    weighted, h = fitted_nmf(t)
    w = X.nmf_transform(weighted, h, TOPICS, row="name", column="token")
    return X.factor_shares(w, "name", "w", TOPICS)


@query("topic_labels")
def topic_labels(t):
    _, h = fitted_nmf(t)
    return X.topic_labels(X.long_topics(X.factor_shares(h, "token", "h", TOPICS), "token", TOPICS))


@query("lda_places")
def lda_places(t):
    cells = stored(document_cells(t))
    terms = durable(W.with_token_ids(cells.groupBy("token").agg(F.sum("value").alias("frequency"))))
    ids = terms.select("token", "token_id")
    model = X.fit_lda(cells.join(ids, "token"), TOPICS, seed=42, row="doc_id")
    counts = cells.join(document_places(t), "doc_id").groupBy("name", "token").agg(F.sum("value").alias("value"))
    return X.lda_doc_topics(model, counts.join(ids, "token"), row="name", least=0.0)


_EMOTION = """
hits AS (SELECT w.id, e.label, sum(e.weight) AS s FROM post_words w JOIN emotion_lexicon e ON e.token = w.token GROUP BY 1, 2),
wide AS (SELECT p.id, p.date, coalesce(max(CASE WHEN label = 'anger' THEN s END), 0) AS a, coalesce(max(CASE WHEN label = 'fear' THEN s END), 0) AS f,
  coalesce(max(CASE WHEN label = 'joy' THEN s END), 0) AS j, coalesce(max(CASE WHEN label = 'sadness' THEN s END), 0) AS d
  FROM (SELECT event_id + 1 AS id, CAST(ts AS DATE) AS date FROM events) p LEFT JOIN hits h ON h.id = p.id GROUP BY 1, 2),
soft AS (SELECT id, date, exp(a - m) AS a, exp(f - m) AS f, exp(j - m) AS j, exp(d - m) AS d FROM (
  SELECT *, greatest(a, f, j, d) AS m FROM wide)),
emotion AS (SELECT id, date, a / (a + f + j + d) AS anger, f / (a + f + j + d) AS fear, j / (a + f + j + d) AS joy, d / (a + f + j + d) AS sadness FROM soft)"""
_EMOTION_VIEWS = ["post_words", "emotion_lexicon"]


def scored_posts(t):
    return P.emotion_scores(t.posts.select("id", "date", "text"), t.emotion_lexicon)


@query("emotion_scores", f"""
WITH {_EMOTION} SELECT id, CAST(date AS VARCHAR) AS date, round(anger, 6) AS anger, round(fear, 6) AS fear, round(joy, 6) AS joy,
round(sadness, 6) AS sadness FROM emotion""", _EMOTION_VIEWS)
def emotion_scores(t):
    return rounded(scored_posts(t).withColumn("date", F.col("date").cast("string")))


def scored_places(t):
    return scored_posts(t).join(placed_points(t).select("id", "name"), "id")


_MEDIANS = " UNION ALL ".join(
    f"SELECT b.name, '{e}' AS label, round(median({e}), 6) AS value FROM emotion e JOIN coords c ON c.id = e.id JOIN boxes b ON {_INSIDE} GROUP BY 1"
    for e in P.EMOTIONS)


@query("place_emotion", f"WITH {_EMOTION} {_MEDIANS}", _EMOTION_VIEWS + ["coords", "boxes"])
def place_emotion(t):
    return rounded(P.place_emotion(scored_places(t)))


@query("daily_emotion", f"""
WITH {_EMOTION} SELECT CAST(date AS VARCHAR) AS date, round(avg(anger), 6) AS anger, round(avg(fear), 6) AS fear,
round(avg(joy), 6) AS joy, round(avg(sadness), 6) AS sadness FROM emotion GROUP BY 1""", _EMOTION_VIEWS)
def daily_emotion(t):
    return rounded(P.daily_emotion(scored_posts(t)).withColumn("date", F.col("date").cast("string")))


@query("topic_emotion_corr", """
SELECT a AS left, b AS right, round(r, 6) AS correlation FROM (
  SELECT 'x' AS a, 'followers_count' AS b, corr(x, followers_count) AS r FROM v UNION ALL
  SELECT 'x', 'statuses_count', corr(x, statuses_count) FROM v UNION ALL
  SELECT 'friends_count', 'followers_count', corr(friends_count, followers_count) FROM v UNION ALL
  SELECT 'friends_count', 'statuses_count', corr(friends_count, statuses_count) FROM v)""".replace("FROM v", """FROM (
  SELECT CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id * 17 % 101 END AS x, friends_count, followers_count, statuses_count FROM profiles)"""), ["profiles"])
def topic_emotion_corr(t):
    x = F.when(F.col("user_id") % 5 != 0, F.col("user_id") * 17 % 101)
    table = t.profiles.withColumn("x", x)
    return rounded(C.correlations(table, ["x", "friends_count"], ["followers_count", "statuses_count"]))


_PROFILES = f"""
profiles_by_place AS (SELECT b.name, e.event_type AS topic, CAST(count(*) AS DOUBLE) AS share FROM events e
  JOIN coords c ON c.id = e.event_id + 1 JOIN boxes b ON {_INSIDE} GROUP BY 1, 2),
unit AS (SELECT name, topic, share / sqrt(sum(share * share) OVER (PARTITION BY name)) AS x FROM profiles_by_place)"""


@query("place_cosine", f"""
WITH {_PROFILES} SELECT a.name, b.name AS other, round(sum(a.x * b.x), 6) AS similarity FROM unit a
JOIN unit b ON b.topic = a.topic GROUP BY 1, 2""", ["coords", "boxes"])
def place_cosine(t):
    kinds = t.events.select((F.col("event_id") + 1).alias("id"), F.col("event_type").alias("topic"))
    profiles = placed_points(t).join(kinds, "id").groupBy("name", "topic").agg(F.count(F.lit(1)).cast("double").alias("share"))
    return rounded(P.place_cosine(durable(profiles)))
