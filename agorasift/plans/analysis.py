"""Queries over consolidated users, anomalies and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorasift.functions import text as T
from agorasift.operators import anomalies as N
from agorasift.operators import communities as K
from agorasift.operators import consolidate as C
from agorasift.operators import daily
from agorasift.operators import graph as G
from agorasift.operators.durable import durable
from agorasift.plans.days import user_tokens
from agorasift.plans.registry import query

REFERENCE = "2024-02-01 00:00:00"


def day_text():
    return F.col("date").cast("string").alias("date")


_CONSOLIDATED = """
consolidated AS (
  SELECT u.user_id, u.dataset_posts, p.predicted_class AS predicted_stance, a.predicted_class AS predicted_age
  FROM users u JOIN predictions p ON p.user_id = u.user_id JOIN ages a ON a.user_id = u.user_id
  WHERE p.predicted_class <> 'noise' AND a.predicted_class <> 'noise')"""
_BASE = ["users", "predictions", "ages"]


def consolidated(t):
    return C.consolidate_users(t.users, "stance", t.predictions, {"relevance": t.ages, "age": t.ages})


@query("consolidated_users", f"WITH {_CONSOLIDATED} SELECT * FROM consolidated", _BASE)
def consolidated_users(t):
    return consolidated(t)


_STATS = """
stats AS (
  SELECT e.user_id + 1 AS user_id, CAST(e.ts AS DATE) AS date, count(*) AS statuses_count,
         count_if(event_type = 'click') AS rts_count, count_if(event_type = 'view') AS quotes_count,
         count_if(event_type = 'error') AS replies_count
  FROM events e JOIN customer c ON c.c_custkey = e.user_id GROUP BY 1, 2)"""


def stats(t):
    made = daily.user_daily_stats(t.posts, t.profiles)
    return made.select("user_id", "date", *N.VOLUMES, "followers_count", "friends_count", "profile_statuses_count")


@query("daily_stats_by_group", f"""
WITH {_CONSOLIDATED}, {_STATS}
SELECT s.user_id, CAST(s.date AS VARCHAR) AS date, s.statuses_count, s.rts_count, c.predicted_stance
FROM stats s JOIN consolidated c ON c.user_id = s.user_id""", _BASE)
def daily_stats_by_group(t):
    tagged = C.daily_stats_by_group(stats(t), consolidated(t), t.predictions, "stance")
    return tagged.select("user_id", day_text(), "statuses_count", "rts_count", "predicted_stance")


@query("word_frequencies", """
SELECT p.predicted_class AS predicted_stance, w.token, CAST(w.date AS VARCHAR) AS date, count(DISTINCT w.user_id) AS n_users,
       count(*) AS frequency FROM post_words w JOIN predictions p ON p.user_id = w.user_id AND p.predicted_class <> 'noise'
GROUP BY 1, 2, 3""", ["post_words", "predictions"])
def word_frequencies(t):
    words = C.word_frequencies(user_tokens(t, ("user_id", "date")), t.predictions, "stance")
    return words.select("predicted_stance", "token", day_text(), "n_users", "frequency")


_WALK = """
layered AS (SELECT layer, src, dst FROM edges WHERE src IN (SELECT user_id FROM consolidated) GROUP BY 1, 2, 3 HAVING sum(weight) >= 2),
walk AS (SELECT layer, src AS node, src AS label FROM layered UNION SELECT layer, dst, dst FROM layered UNION
  SELECT h.layer, h.b, w.label FROM walk w JOIN (
    SELECT layer, src AS a, dst AS b FROM layered UNION SELECT layer, dst, src FROM layered) h ON h.layer = w.layer AND h.a = w.node)"""


@query("node_components", f"""
WITH RECURSIVE {_CONSOLIDATED},{_WALK}
SELECT layer, node, min(label) AS component FROM walk GROUP BY 1, 2""", _BASE + ["edges"])
def node_components(t):
    users = consolidated(t)
    parts = [layer_components(t, layer, users).withColumn("layer", F.lit(layer)) for layer in daily.LAYERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def layer_components(t, layer, users):
    edges = G.interactions_total(t.edges.where(F.col("layer") == layer))
    return G.node_components(edges, users, min_weight=2)


_VOLUME = """
volume AS (SELECT user_id, ln(1 + sum(statuses_count)) AS v1, ln(1 + sum(rts_count)) AS v2, ln(1 + sum(quotes_count)) AS v3,
           ln(1 + sum(replies_count)) AS v4, count(*) AS active_days FROM stats GROUP BY 1)"""


@query("user_volume", f"""
WITH {_STATS}, {_VOLUME}
SELECT user_id, round(v1, 6) AS transformed_statuses_count, round(v2, 6) AS transformed_rts_count,
       round(v3, 6) AS transformed_quotes_count, round(v4, 6) AS transformed_replies_count FROM volume""")
def user_volume(t):
    return rounded(N.user_volume(stats(t)))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def latest(t):
    return G.latest_profile(t.profiles).drop("description")


_LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS n FROM profiles) WHERE n = 1)"""
_RATIO = "CASE WHEN followers_count = 0 THEN 0 ELSE ln(1 + friends_count) / ln(1 + followers_count) END"


@query("friend_ratio", f"""
WITH {_LATEST} SELECT user_id, round({_RATIO}, 6) AS ratio_friends_over_followers,
  length(CAST(user_id AS VARCHAR)) AS n_digits_username FROM latest""", ["profiles"])
def friend_ratio(t):
    return rounded(N.friend_ratio(latest(t)).withColumn("n_digits_username", F.col("n_digits_username").cast("long")))


@query("component_onehot", """
WITH RECURSIVE layered AS (SELECT src, dst FROM edges WHERE layer = 'quote' GROUP BY 1, 2 HAVING sum(weight) >= 2),
walk AS (SELECT src AS node, src AS label FROM layered UNION SELECT dst, dst FROM layered UNION
  SELECT h.b, w.label FROM walk w JOIN (SELECT src AS a, dst AS b FROM layered UNION SELECT dst, src FROM layered) h ON h.a = w.node),
parts AS (SELECT node, min(label) AS component FROM walk GROUP BY 1),
large AS (SELECT component FROM parts GROUP BY 1 HAVING count(*) >= 2)
SELECT p.node AS user_id, concat('quote_component_', p.component) AS feature, 1.0::DOUBLE AS value
FROM parts p WHERE p.component IN (SELECT component FROM large)""", ["edges"])
def component_onehot(t):
    edges = G.interactions_total(t.edges.where(F.col("layer") == "quote"))
    return N.component_cells(G.node_components(edges, t.users, min_weight=2), "quote", least=2)


@query("active_days", f"""
WITH {_STATS}, {_VOLUME} SELECT u.user_id, coalesce(v.active_days, 0) AS active_days,
  round(coalesce(u.dataset_posts / v.active_days, 0), 6) AS daily_rhythm FROM users u LEFT JOIN volume v ON v.user_id = u.user_id""", ["users"])
def active_days(t):
    return rounded(N.active_days(stats(t), t.users))


_AGE = "CAST(DATE '2024-02-01' - created_at AS BIGINT)"
_RHYTHM = f"""
rhythm AS (SELECT user_id, {_AGE} AS account_age_days, ln(1 + statuses_count) / ({_AGE} + 1) AS g1,
  ln(1 + followers_count) / ({_AGE} + 1) AS g2, ln(1 + friends_count) / ({_AGE} + 1) AS g3 FROM latest)"""


@query("global_rhythm", f"""
WITH {_LATEST}, {_RHYTHM}, {_STATS}, {_VOLUME}
SELECT r.user_id, account_age_days, round(g1, 6) AS global_daily_rhythm, round(g2, 6) AS global_follower_rhythm,
       round(g3, 6) AS global_friend_rhythm, round(v1 / active_days, 6) AS transformed_statuses_count,
       round(v2 / active_days, 6) AS transformed_rts_count, round(v3 / active_days, 6) AS transformed_quotes_count,
       round(v4 / active_days, 6) AS transformed_replies_count
FROM rhythm r JOIN volume v ON v.user_id = r.user_id""", ["profiles"])
def global_rhythm(t):
    daily_stats = stats(t)
    relative = N.relative_volume(N.user_volume(daily_stats), N.active_days(daily_stats, t.users))
    return rounded(N.global_rhythm(latest(t), REFERENCE).join(relative, "user_id"))


@query("first_last_snapshot", """
SELECT user_id, CAST(min(date) AS VARCHAR) AS date, arg_min(statuses_count, date) AS statuses_count,
       arg_min(followers_count, date) AS followers_count, 'first' AS snapshot FROM profiles GROUP BY 1
UNION ALL SELECT user_id, CAST(max(date) AS VARCHAR), arg_max(statuses_count, date), arg_max(followers_count, date), 'last'
FROM profiles GROUP BY 1""", ["profiles"])
def first_last_snapshot(t):
    snapshots = t.profiles.select("user_id", "date", "statuses_count", "followers_count")
    return N.first_last_snapshot(snapshots).withColumn("date", day_text())


@query("counter_diff", """
SELECT user_id, CAST(date_end AS VARCHAR) AS date_end, statuses_count_diff, followers_count_diff, friends_count_diff FROM (
  SELECT user_id, lead(date) OVER w AS date_end, lead(statuses_count) OVER w - statuses_count AS statuses_count_diff,
         lead(followers_count) OVER w - followers_count AS followers_count_diff,
         lead(friends_count) OVER w - friends_count AS friends_count_diff
  FROM profiles WINDOW w AS (PARTITION BY user_id ORDER BY date)) WHERE date_end IS NOT NULL""", ["profiles"])
def counter_diff(t):
    changes = N.counter_diff(t.profiles, ["statuses_count", "followers_count", "friends_count"])
    return changes.withColumn("date_end", F.col("date_end").cast("string"))


COMPONENTS = tuple(f"{layer}_component" for layer in daily.LAYERS)


def features(t):
    """All features of the consolidated users; a component's id says which of the 0/1 columns of its layer is one."""
    daily_stats = durable(stats(t))
    days = N.active_days(daily_stats, t.users)
    profile = durable(latest(t))
    parts = [
        N.relative_volume(N.user_volume(daily_stats), days), N.friend_ratio(profile), days, N.global_rhythm(profile, REFERENCE),
    ]
    users = durable(consolidated(t))
    parts += [N.component_of(layer_components(t, layer, users), layer) for layer in daily.LAYERS]
    return N.feature_table(users, parts, COMPONENTS)


@query("anomaly_features", f"""
WITH RECURSIVE {_CONSOLIDATED}, {_LATEST}, {_RHYTHM}, {_STATS}, {_VOLUME},{_WALK},
parts AS (SELECT layer, node, min(label) AS component FROM walk GROUP BY 1, 2),
large AS (SELECT layer, component FROM parts GROUP BY 1, 2 HAVING count(*) >= 10),
belongs AS (SELECT node, max(component) FILTER (WHERE layer = 'retweet') AS retweet_component,
  max(component) FILTER (WHERE layer = 'quote') AS quote_component, max(component) FILTER (WHERE layer = 'reply') AS reply_component
  FROM parts WHERE (layer, component) IN (SELECT (layer, component) FROM large) GROUP BY 1)
SELECT c.user_id, CAST(account_age_days AS DOUBLE) AS account_age_days, round(g1, 6) AS global_daily_rhythm,
       round(g2, 6) AS global_follower_rhythm, round(g3, 6) AS global_friend_rhythm,
       round(v1 / active_days, 6) AS transformed_statuses_count, round(v2 / active_days, 6) AS transformed_rts_count,
       round(v3 / active_days, 6) AS transformed_quotes_count, round(v4 / active_days, 6) AS transformed_replies_count,
       CAST(active_days AS DOUBLE) AS active_days, round(c.dataset_posts / active_days, 6) AS daily_rhythm,
       round({_RATIO}, 6) AS ratio_friends_over_followers, CAST(length(CAST(c.user_id AS VARCHAR)) AS DOUBLE) AS n_digits_username,
       b.retweet_component, b.quote_component, b.reply_component
FROM consolidated c JOIN latest l ON l.user_id = c.user_id JOIN rhythm r ON r.user_id = c.user_id
JOIN volume v ON v.user_id = c.user_id LEFT JOIN belongs b ON b.node = c.user_id""", _BASE + ["profiles", "edges"])
def anomaly_features(t):
    return rounded(features(t))


@query("anomaly_scores")
def anomaly_scores(t):
    table = durable(features(t))
    return N.anomaly_labels(N.isolation_scores(table, categories=COMPONENTS)).select(
        "user_id", "score", "anomaly_label")


@query("anomaly_labels", """
SELECT *, round(n / sum(n) OVER (PARTITION BY predicted_class), 6) AS share FROM (
  SELECT predicted_class, CASE WHEN p_alpha - 0.25 < 0 THEN 'anomalous' ELSE 'normal' END AS anomaly_label, count(*) AS n
  FROM predictions GROUP BY 1, 2)""", ["predictions"])
def anomaly_labels(t):
    scored = t.predictions.withColumn("score", F.col("p_alpha") - 0.25)
    return rounded(N.label_shares(N.anomaly_labels(scored), "predicted_class"))


@query("induced_edges", f"""
WITH {_CONSOLIDATED} SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges WHERE layer = 'retweet'
AND src IN (SELECT user_id FROM consolidated WHERE dataset_posts >= 1)
AND dst IN (SELECT user_id FROM consolidated WHERE dataset_posts >= 1) GROUP BY 1, 2""", _BASE + ["edges"])
def induced_edges(t):
    return retweet_network(t)


def retweet_network(t):
    active = consolidated(t).where(F.col("dataset_posts") >= 1).select(F.col("user_id").alias("node"))
    return G.induced_edges(G.interactions_total(t.edges.where(F.col("layer") == "retweet"), ()), active)


@query("communities")
def communities(t):
    edges = durable(retweet_network(t))
    strong = G.largest_component(G.strong_components(edges))
    return K.communities(durable(G.induced_edges(edges, strong)))


@query("modularity", """
WITH pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(weight) AS DOUBLE) AS w FROM edges
  WHERE layer = 'retweet' AND src <> dst GROUP BY 1, 2),
links AS (SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b, a, w FROM pairs),
sums AS (SELECT src % 7 AS community, sum(CASE WHEN src % 7 = dst % 7 THEN w ELSE 0 END) AS inner_w, sum(w) AS degree FROM links GROUP BY 1)
SELECT community, inner_w AS inner, degree,
  round(inner_w / (SELECT sum(w) FROM links) - (degree / (SELECT sum(w) FROM links)) * (degree / (SELECT sum(w) FROM links)), 6) AS modularity
FROM sums""", ["edges"])
def modularity(t):
    edges = t.edges.where(F.col("layer") == "retweet")
    labels = G.graph_nodes(edges).withColumn("community", F.col("node") % 7)
    return rounded(K.modularity(edges, labels))
