"""Queries over experiment consolidation: networks, vocabularies, matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorasift.functions import text as T
from agorasift.operators import daily
from agorasift.operators import embeddings as E
from agorasift.operators import graph as G
from agorasift.operators import vocabulary as W
from agorasift.operators.durable import stored
from agorasift.plans import views as V
from agorasift.plans.days import user_tokens
from agorasift.plans.registry import query

MIN_WEIGHT, MIN_DEGREE = 2, 2
POST_MIN, DESCRIPTION_MIN = 200, 50


@query("interactions_total", """
SELECT layer, src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY 1, 2, 3""", ["edges"])
def interactions_total(t):
    return G.interactions_total(t.edges)


@query("dataset_posts", "SELECT user_id, dataset_posts FROM users", ["users"])
def dataset_posts(t):
    return G.dataset_posts(daily.posts_per_user(t.posts, ["user_id", "date"]))


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS n FROM profiles) WHERE n = 1)"


@query("latest_profile", f"""
SELECT user_id, CAST(date AS VARCHAR) AS date, name, md5(description) AS description_md5, followers_count, statuses_count
FROM {_LATEST}""", ["profiles"])
def latest_profile(t):
    latest = G.latest_profile(t.profiles)
    return latest.select("user_id", F.col("date").cast("string").alias("date"), "name",
                         F.md5("description").alias("description_md5"), "followers_count", "statuses_count")


@query("multiplex_edges", "SELECT * FROM multiplex", ["multiplex"])
def multiplex_edges(t):
    return G.multiplex_edges(t.edges)


@query("edge_threshold", f"SELECT * FROM multiplex WHERE weight >= {MIN_WEIGHT}", ["multiplex"])
def edge_threshold(t):
    return G.edge_threshold(G.multiplex_edges(t.edges), MIN_WEIGHT)


@query("weak_component", "SELECT node FROM members", ["members"])
def weak_component(t):
    heavy = G.edge_threshold(G.multiplex_edges(t.edges), MIN_WEIGHT)
    return G.largest_component(G.weak_components(heavy))


@query("strong_component", f"""
WITH RECURSIVE heavy AS (SELECT src, dst FROM multiplex WHERE weight >= {MIN_WEIGHT}),
ends AS (SELECT src AS node FROM heavy UNION SELECT dst FROM heavy),
reach AS (SELECT node AS a, node AS b FROM ends UNION SELECT r.a, h.dst FROM reach r JOIN heavy h ON h.src = r.b),
strong AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1),
best AS (SELECT component FROM strong GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
SELECT node FROM strong WHERE component = (SELECT component FROM best)""", ["multiplex"])
def strong_component(t):
    heavy = G.edge_threshold(G.multiplex_edges(t.edges), MIN_WEIGHT)
    return G.largest_component(G.strong_components(heavy))


def discussion(t):
    return G.discussion_nodes(G.multiplex_edges(t.edges), min_edge_weight=MIN_WEIGHT, min_total_degree=MIN_DEGREE)


@query("degree_filter", "SELECT node FROM discussion", ["discussion"])
def degree_filter(t):
    return discussion(t)


def chosen_users(t):
    return G.discussion_users(t.profiles, discussion(t), t.users)


def row_ids(t):
    """Row ids of the users in the discussion."""
    members = t.users.join(discussion(t).withColumnRenamed("node", "user_id"), "user_id", "left_semi")
    return G.element_ids(members)


@query("discussion_users", f"""
SELECT p.user_id, p.name, md5(p.description) AS description_md5, u.dataset_posts
FROM {_LATEST} p JOIN users u ON u.user_id = p.user_id WHERE p.user_id IN (SELECT node FROM discussion)""",
       ["profiles", "users", "discussion"])
def discussion_users(t):
    return chosen_users(t).select("user_id", "name", F.md5("description").alias("description_md5"), "dataset_posts")


@query("element_ids", "SELECT user_id, row_id FROM row_ids", ["row_ids"])
def element_ids(t):
    return row_ids(t)


@query("build_vocabulary", """
SELECT lower(token) AS token, count(*) AS frequency FROM doc_words GROUP BY 1""", ["doc_words"])
def build_vocabulary(t):
    return W.build_vocabulary(t.documents, T.tokenize(F.col("text"), lower=False))


def post_vocabulary(t, tokens=None):
    words = daily.token_frequency(t.posts, T.tokenize, text="text") if tokens is None else tokens
    return W.relevant_vocabulary(words, POST_MIN, t.stopwords)


@query("relevant_vocabulary", "SELECT token, frequency, token_id FROM post_vocab", ["post_vocab"])
def relevant_vocabulary(t):
    words = daily.token_frequency(t.posts, T.tokenize, text="text")
    return W.relevant_vocabulary(words, POST_MIN, t.spark.createDataFrame([(w,) for w in t.stopwords], "token string"))


@query("top_vocabulary", "SELECT token, frequency, token_id FROM post_vocab WHERE token_id < 100", ["post_vocab"])
def top_vocabulary(t):
    totals = daily.token_totals(user_tokens(t)).withColumnRenamed("total_frequency", "frequency")
    return W.relevant_vocabulary(totals, POST_MIN, t.stopwords).where(F.col("token_id") < 100)


@query("dtm_name", """
WITH words AS (SELECT user_id, unnest(['customer', concat('#', substr(name, 10))]) AS token FROM profiles),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id FROM words GROUP BY token
          HAVING count(*) >= 20)
SELECT r.row_id, v.token_id, count(*) AS value FROM words w JOIN vocab v ON v.token = w.token
JOIN row_ids r ON r.user_id = w.user_id GROUP BY 1, 2""", ["profiles", "row_ids"])
def dtm_name(t):
    tokens = T.tokenize(F.col("name"))
    vocabulary = W.relevant_vocabulary(W.build_vocabulary(t.profiles, tokens), 20)
    return W.document_term_matrix(t.profiles, tokens, vocabulary, row_ids(t))


def description_vocabulary(t):
    words = daily.token_frequency(t.profiles, T.tokenize, text="description")
    return W.relevant_vocabulary(words, DESCRIPTION_MIN, t.stopwords)


@query("dtm_description", """
SELECT r.row_id, v.token_id, count(*) AS value FROM profile_words w JOIN description_vocab v ON v.token = w.token
JOIN row_ids r ON r.user_id = w.user_id GROUP BY 1, 2""", ["profile_words", "description_vocab", "row_ids"])
def dtm_description(t):
    return W.document_term_matrix(t.profiles, T.tokenize, description_vocabulary(t), row_ids(t), text="description")


def post_matrix(t):
    tokens = stored(user_tokens(t))  # used twice, and costly to make
    return W.term_matrix(tokens, post_vocabulary(t, tokens), row_ids(t))


@query("dtm_posts", """
SELECT r.row_id, v.token_id, w.frequency AS value FROM user_tokens w JOIN post_vocab v ON v.token = w.token
JOIN row_ids r ON r.user_id = w.user_id""", ["user_tokens", "post_vocab", "row_ids"])
def dtm_posts(t):
    return post_matrix(t)


def layer_adjacency(t, layer):
    edges = G.interactions_total(t.edges.where(F.col("layer") == layer))
    return W.adjacency(edges, row_ids(t))


for _layer in daily.LAYERS:
    query(f"adjacency_{_layer}", f"""
WITH own AS (SELECT r.row_id, e.dst, CAST(sum(e.weight) AS BIGINT) AS value FROM edges e
             JOIN row_ids r ON r.user_id = e.src WHERE e.layer = '{_layer}' GROUP BY 1, 2),
nodes AS (SELECT user_id AS id, row_id AS node_id FROM row_ids UNION ALL
          SELECT dst, (SELECT count(*) FROM row_ids) + row_number() OVER (ORDER BY dst) - 1
          FROM (SELECT DISTINCT dst FROM own WHERE dst NOT IN (SELECT user_id FROM row_ids)))
SELECT o.row_id, n.node_id, o.dst, o.value FROM own o JOIN nodes n ON n.id = o.dst""", ["edges", "row_ids"])(
        lambda t, layer=_layer: _named_adjacency(*layer_adjacency(t, layer)))


def _named_adjacency(ids, matrix):
    return matrix.join(ids.withColumnRenamed("id", "dst"), "node_id").select("row_id", "node_id", "dst", "value")


def post_domains(t):
    return daily.user_domains(t.posts, F.array("url"))


@query("domain_vocabulary", "SELECT domain, frequency, token_id FROM domain_vocab", ["domain_vocab"])
def domain_vocabulary(t):
    return W.domain_vocabulary(post_domains(t), 10)


@query("domain_matrix", """
SELECT r.row_id, v.token_id, u.frequency AS value FROM user_domains u JOIN domain_vocab v ON v.domain = u.domain
JOIN row_ids r ON r.user_id = u.user_id""", ["domain_vocab", "user_domains", "row_ids"])
def domain_matrix(t):
    domains = post_domains(t)
    return W.term_matrix(domains, W.domain_vocabulary(domains, 10), row_ids(t), column="domain")


_PROFILE = f"""
WITH linked_profiles AS (SELECT user_id, {{0}} AS item FROM (SELECT user_id, {V.HOST.replace('{0}', 'url')} AS host FROM profiles)),
vocab AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) - 1 AS token_id FROM linked_profiles
          GROUP BY item HAVING count(*) >= {{1}})
SELECT DISTINCT r.row_id, v.token_id, 1 AS value FROM linked_profiles p JOIN vocab v ON v.item = p.item
JOIN row_ids r ON r.user_id = p.user_id"""


def _profile_sql(item: str, least: int) -> str:
    return _PROFILE.replace("{0}", item).replace("{1}", str(least)).replace("{{", "{").replace("}}", "}")


@query("profile_domain_matrix", _profile_sql(r"regexp_extract(host, '([^.]*\.)?[^.]*$')", 30), ["profiles", "row_ids"])
def profile_domain_matrix(t):
    return W.presence_matrix(W.profile_domains(t.profiles), "main_domain", 30, row_ids(t))[1]


@query("profile_tld_matrix", _profile_sql("regexp_extract(host, '[^.]*$')", 50), ["profiles", "row_ids"])
def profile_tld_matrix(t):
    return W.presence_matrix(W.profile_domains(t.profiles), "tld", 50, row_ids(t))[1]


@query("user_embeddings", """
SELECT label, pos, round(avg(x), 6) AS x FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2""")
def user_embeddings(t):
    means = W.mean_vectors(t.embeddings, "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("text_embeddings", """
SELECT r.row_id, v.pos, v.value FROM user_vectors v JOIN row_ids r ON r.user_id = v.user_id""", ["user_vectors", "row_ids"])
def text_embeddings(t):
    posts = t.posts.withColumn("tokens", T.tokenize(F.col("text")))
    return E.user_vectors(posts, E.hashed_ngrams(), row_ids(t))


@query("features_with_names", """
SELECT r.row_id, v.token_id, u.frequency AS value, v.domain AS token, 'domain' AS type FROM user_domains u
JOIN domain_vocab v ON v.domain = u.domain JOIN row_ids r ON r.user_id = u.user_id""",
       ["domain_vocab", "user_domains", "row_ids"])
def features_with_names(t):
    domains = post_domains(t)
    vocabulary = W.domain_vocabulary(domains, 10)
    matrix = W.term_matrix(domains, vocabulary, row_ids(t), column="domain")
    return W.features_with_names(matrix, vocabulary, "domain", key="domain")
