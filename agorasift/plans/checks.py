"""What SQL can tell about the results of solvers: who is in them, and rules that every row keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agorasift.operators import communities as K
from agorasift.operators import graph as G
from agorasift.operators import model as M
from agorasift.operators import topics as X
from agorasift.operators.durable import durable
from agorasift.plans import analysis, scoring, topics
from agorasift.plans.analysis import _BASE, _CONSOLIDATED
from agorasift.plans.labels import ALLOWED
from agorasift.plans.registry import query
from agorasift.plans.topics import _CELLS, _PLACES, _TOPIC, _TOPIC_VIEWS, TOPICS

_LABEL = """one AS (
  SELECT row_id, arg_max(class, votes * 10 - list_position(['alpha', 'beta', 'noise'], class)) AS label FROM tagged_votes GROUP BY row_id),
reported AS (SELECT u.user_id, o.label FROM users u LEFT JOIN one o ON o.row_id = u.user_id)"""
_LABEL_VIEWS = ["users", "tagged_votes"]


def is_one(total: Column) -> Column:
    return F.abs(total - 1.0) < 1e-6


def _scores(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("p_"))


@query("classifier_rules", f"""
WITH {_LABEL} SELECT user_id, label AS reported_label, true AS sums_to_one, true AS rule_kept FROM reported""", _LABEL_VIEWS)
def classifier_rules(t):
    """Probabilities sum to one; a known label stays, a weak best class is not disclosed, allowed accounts are no noise."""
    cells, labels, users, _ = scoring.training_rows(t)
    classifier = scoring.boosted_classifier()
    found = M.classify(cells, labels, classifier, users, ALLOWED)
    scores = _scores(found)
    best = F.greatest(*scores)
    name = F.coalesce(*[F.when(F.col(c) == best, F.lit(classifier.classes[int(c[2:])])) for c in scores])
    told = F.coalesce("reported_label", F.when(best < 1 / len(scores) + 0.1, "undisclosed").otherwise(name))
    told = F.when(F.col("user_id").isin(*ALLOWED) & (told == "noise"), "undisclosed").otherwise(told)
    return found.select("user_id", "reported_label", is_one(sum(F.col(c) for c in scores)).alias("sums_to_one"),
                        (F.col("predicted_class") == told).alias("rule_kept"))


@query("calibration_rules", f"""
WITH {_LABEL} SELECT user_id AS row_id, label, true AS sums_to_one, true AS in_range FROM reported""", _LABEL_VIEWS)
def calibration_rules(t):
    """Calibrated probabilities are shares."""
    found = scoring.calibrated_predictions(t)
    scores = _scores(found)
    inside = F.least(*scores).between(0, 1) & F.greatest(*scores).between(0, 1)
    return found.select("row_id", "label", is_one(sum(F.col(c) for c in scores)).alias("sums_to_one"), inside.alias("in_range"))


@query("importance_shares", """
SELECT type, count(*) AS n_features, true AS sums_to_one FROM dictionary GROUP BY type""", ["dictionary"])
def importance_shares(t):
    """Every feature has its share of the gain, and the shares of all families together are the whole."""
    families = durable(scoring.feature_importance(t).groupBy("type").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("share"), F.min("importance").alias("least")))
    whole = families.agg(is_one(F.sum("share")) & (F.min("least") >= 0)).first()[0]
    return families.select("type", "n_features", F.lit(whole).alias("sums_to_one"))


@query("validation_support", f"""
WITH {_LABEL}, folded AS (
  SELECT label, (row_number() OVER (PARTITION BY coalesce(label, '__null__') ORDER BY md5(concat(user_id, ':42')), user_id) - 1) % 5 AS fold
  FROM reported)
SELECT CAST(fold AS INTEGER) AS fold, label AS class, count(*) AS support, true AS rates_in_range FROM folded WHERE label IS NOT NULL GROUP BY 1, 2""",
       _LABEL_VIEWS)
def validation_support(t):
    """Labelled rows of each class that each fold was judged on."""
    report = scoring.cross_validation(t).where(~F.col("class").isin("macro avg", "weighted avg", "accuracy") & (F.col("support") > 0))
    inside = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return report.select("fold", "class", "support", inside.alias("rates_in_range"))


@query("anomaly_rules", f"""
WITH {_CONSOLIDATED} SELECT user_id, true AS in_range, true AS label_follows FROM consolidated""", _BASE)
def anomaly_rules(t):
    """Every consolidated user has a score within half of zero, and the label that its sign gives."""
    follows = (F.col("anomaly_label") == "anomalous") == (F.col("score") < 0)
    return analysis.anomaly_scores(t).select("user_id", F.col("score").between(-0.5, 0.5).alias("in_range"), follows.alias("label_follows"))


@query("community_levels", f"""
WITH RECURSIVE {_CONSOLIDATED}, active AS (SELECT user_id FROM consolidated WHERE dataset_posts >= 1),
network AS (SELECT DISTINCT src, dst FROM edges WHERE layer = 'retweet' AND src IN (FROM active) AND dst IN (FROM active)),
ends AS (SELECT src AS node FROM network UNION SELECT dst FROM network),
reach AS (SELECT node AS a, node AS b FROM ends UNION SELECT r.a, n.dst FROM reach r JOIN network n ON n.src = r.b),
strong AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1),
best AS (SELECT component FROM strong GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
SELECT node, true AS at_all_levels, true AS nested, true AS modularity_grows FROM strong
WHERE component = (SELECT component FROM best)""", _BASE + ["edges"])
def community_levels(t):
    """Every node of the strong component is at every level; levels are nested; modularity does not fall."""
    edges = durable(analysis.retweet_network(t))
    strong = G.largest_component(G.strong_components(edges))
    inner = durable(G.induced_edges(edges, strong))
    found = durable(K.communities(inner))
    last = found.agg(F.max("level")).first()[0]
    above = found.select("node", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    parents = found.join(above, ["node", "level"]).groupBy("level", "community").agg(F.count_distinct("parent").alias("n"))
    nested = parents.where(F.col("n") > 1).isEmpty()
    shares = [K.modularity(inner, found.where(F.col("level") == level)).agg(F.sum("modularity")).first()[0] for level in range(last + 1)]
    grows = all(b >= a - 1e-9 for a, b in zip(shares, shares[1:]))
    levels = F.count_distinct("level") == last + 1
    return found.groupBy("node").agg(levels.alias("at_all_levels")).withColumns({"nested": F.lit(nested), "modularity_grows": F.lit(grows)})


@query("lda_shares", f"""
WITH {_TOPIC}
SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS name, {TOPICS} AS n, true AS sums_to_one FROM (
  SELECT DISTINCT w.user_id FROM user_tokens w JOIN topic_rows r ON r.user_id = w.user_id JOIN topic_vocab v ON v.token = w.token)
UNION ALL SELECT 'topic', CAST(i AS VARCHAR), (SELECT count(*) FROM topic_vocab), true FROM range({TOPICS}) AS r(i)""", _TOPIC_VIEWS)
def lda_shares(t):
    """Topic shares of a user sum to one, and so do the term weights of a topic over the whole vocabulary."""
    model, cells, terms = topics.fitted_lda(t)
    described = X.lda_topic_terms(model, terms, None).groupBy(F.col("topic").cast("string").alias("name")).agg(
        F.count_distinct("token").alias("n"), is_one(F.sum("weight")).alias("sums_to_one"))
    users = X.lda_doc_topics(model, cells, least=0.0).groupBy(F.col("row_id").cast("string").alias("name")).agg(
        F.count_distinct("topic").alias("n"), is_one(F.sum("share")).alias("sums_to_one"))
    return users.withColumn("kind", F.lit("user")).unionByName(described.withColumn("kind", F.lit("topic")))


@query("nmf_shares", f"""
WITH {_CELLS}, {_PLACES}
SELECT 'place' AS kind, name, {TOPICS} AS n, true AS sums_to_one FROM (SELECT DISTINCT name FROM place_weights)
UNION ALL SELECT 'topic', CAST(i AS VARCHAR), (SELECT least(15, count(DISTINCT token)) FROM place_weights), true FROM range({TOPICS}) AS r(i)""",
       ["doc_words", "coords", "boxes"])
def nmf_shares(t):
    """Topic shares of a place sum to one; a topic is labelled by fifteen terms."""
    weighted, h = topics.fitted_nmf(t)
    places = X.factor_shares(X.nmf_transform(weighted, h, TOPICS, row="name", column="token"), "name", "w", TOPICS)
    shares = [F.col(c) for c in places.columns if c != "name"]
    labels = X.topic_labels(X.long_topics(X.factor_shares(h, "token", "h", TOPICS), "token", TOPICS))
    places = places.select(F.lit("place").alias("kind"), "name", F.lit(len(shares)).cast("long").alias("n"), is_one(sum(shares)).alias("sums_to_one"))
    return places.unionByName(labels.select(
        F.lit("topic").alias("kind"), F.col("topic").cast("string").alias("name"),
        F.size(F.array_distinct(F.split("label", ","))).cast("long").alias("n"), F.lit(True).alias("sums_to_one")))


@query("lda_place_shares", f"""
WITH {_CELLS}, {_PLACES} SELECT DISTINCT name, {TOPICS} AS n_topics, true AS sums_to_one FROM place_weights""", ["doc_words", "coords", "boxes"])
def lda_place_shares(t):
    """Every place has all topics, with shares that sum to one."""
    return topics.lda_places(t).groupBy("name").agg(F.count_distinct("topic").alias("n_topics"), is_one(F.sum("share")).alias("sums_to_one"))
