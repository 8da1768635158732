"""Queries over the daily tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorasift.functions import text as T
from agorasift.functions import urls as U
from agorasift.operators import daily
from agorasift.plans import views as V
from agorasift.plans.registry import query

def day_text():
    return F.col("date").cast("string").alias("date")


@query("unique_users", """
SELECT user_id, CAST(date AS VARCHAR) AS date, arg_min(url, id) AS url, arg_min(lang, id) AS lang
FROM posts GROUP BY user_id, date""", ["posts"])
def unique_users(t):
    return daily.unique_users(t.posts, ["url", "lang"]).select("user_id", day_text(), "url", "lang")


@query("name_vocabulary", """
SELECT CAST(date AS VARCHAR) AS date, token, count(*) AS frequency FROM (
  SELECT date, unnest(['customer', concat('#', substr(name, 10))]) AS token FROM profiles) GROUP BY 1, 2""", ["profiles"])
def name_vocabulary(t):
    return daily.token_frequency(t.profiles, T.tokenize(F.col("name")), ["date"]).select(day_text(), "token", "frequency")


@query("description_vocabulary", """
SELECT CAST(date AS VARCHAR) AS date, token, count(*) AS frequency FROM profile_words GROUP BY 1, 2""", ["profile_words"])
def description_vocabulary(t):
    words = daily.token_frequency(t.profiles, T.tokenize, ["date"], "description")
    return words.select(day_text(), "token", "frequency")


def _twice(posts):
    """Posts as they arrive, each id seen two times."""
    return posts.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")


@query("posts_per_user", """
SELECT user_id, CAST(date AS VARCHAR) AS date, count(*) AS posts FROM posts GROUP BY user_id, date""", ["posts"])
def posts_per_user(t):
    return daily.posts_per_user(_twice(t.posts), ["user_id", "date"]).select("user_id", day_text(), "posts")


@query("posts_list_per_user", """
SELECT user_id, CAST(floor((n - 1) / 25) AS BIGINT) AS part, count(*) AS n_posts,
       md5(string_agg(text, '|' ORDER BY id)) AS texts_md5
FROM (SELECT user_id, id, text, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM posts) GROUP BY 1, 2""",
       ["posts"])
def posts_list_per_user(t):
    lists = daily.posts_list_per_user(t.posts, chunk=25)
    return lists.select("user_id", "part", F.size("texts").cast("long").alias("n_posts"),
                        F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def user_tokens(t, by=("user_id",)):
    return daily.user_token_frequency(t.posts, T.tokenize, list(by), "text")


@query("user_token_frequency", "SELECT user_id, token, frequency FROM user_tokens", ["user_tokens"])
def user_token_frequency(t):
    return user_tokens(t)


@query("token_totals", """
SELECT token, CAST(sum(frequency) AS BIGINT) AS total_frequency, count(*) AS total_users FROM user_tokens GROUP BY token""",
       ["user_tokens"])
def token_totals(t):
    return daily.token_totals(user_tokens(t))


def _layer_queries():
    for layer, (post, user) in daily.LAYERS.items():
        query(f"{layer}_counts", f"""
SELECT {post}, {user}, count(*) AS frequency FROM posts WHERE {post} > 0 GROUP BY 1, 2""", ["posts"])(
            lambda t, layer=layer: daily.interaction_counts(t.posts, layer).orderBy(F.desc("frequency"), *daily.LAYERS[layer])
        )
        query(f"{layer}_edges", f"""
SELECT CAST(date AS VARCHAR) AS date, user_id AS src, {user} AS dst, count(*) AS weight FROM posts
WHERE {user} > 0 GROUP BY 1, 2, 3""", ["posts"])(
            lambda t, layer=layer: daily.interaction_edges(t.posts, layer, ["date"]).select(day_text(), "src", "dst", "weight")
        )


_layer_queries()


@query("user_urls", f"""
SELECT user_id, CAST(date AS VARCHAR) AS date, domain, count(*) AS frequency FROM (
  SELECT user_id, date, {V.HOST.format('url')} AS domain FROM (
    SELECT user_id, date, url FROM posts UNION ALL SELECT user_id, date, concat('https://bit.ly/', id) FROM posts
    UNION ALL SELECT user_id, date, concat('https://www.', lang, '.example.com:80/x') FROM posts))
WHERE domain NOT IN {V.DISCARDED} GROUP BY 1, 2, 3""", ["posts"])
def user_urls(t):
    links = F.split(
        F.concat(F.col("url"), F.lit("|https://bit.ly/"), F.col("id"), F.lit("|https://www."), F.col("lang"),
                 F.lit(".example.com:80/x")), r"\|")
    return daily.user_domains(t.posts, links, ["user_id", "date"]).select("user_id", day_text(), "domain", "frequency")


@query("activity_counts", """
SELECT user_id, CAST(date AS VARCHAR) AS date, count(*) AS statuses_count, count_if(rt_user_id <> 0) AS rts_count,
       count_if(quote_user_id <> 0) AS quotes_count, count_if(reply_user_id <> 0) AS replies_count
FROM posts GROUP BY user_id, date""", ["posts"])
def activity_counts(t):
    return daily.activity_counts(t.posts, ["user_id", "date"]).drop("plain_count").withColumn("date", day_text())


@query("plain_counts", """
SELECT user_id, CAST(date AS VARCHAR) AS date, count(*) AS plain_count FROM posts
WHERE rt_user_id = 0 AND quote_user_id = 0 AND reply_user_id = 0 GROUP BY user_id, date""", ["posts"])
def plain_counts(t):
    counts = daily.activity_counts(t.posts, ["user_id", "date"])
    return counts.where(F.col("plain_count") > 0).select("user_id", day_text(), "plain_count")


_RECEIVED = """
SELECT date, user_id, count_if(layer = 'retweet') AS rts_received, count_if(layer = 'quote') AS quotes_received,
       count_if(layer = 'reply') AS replies_received FROM (
  SELECT date, rt_user_id AS user_id, 'retweet' AS layer FROM posts WHERE rt_user_id > 0
  UNION ALL SELECT date, quote_user_id, 'quote' FROM posts WHERE quote_user_id > 0
  UNION ALL SELECT date, reply_user_id, 'reply' FROM posts WHERE reply_user_id > 0) GROUP BY date, user_id"""


@query("received_counts", f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({_RECEIVED})", ["posts"])
def received_counts(t):
    return daily.received_counts(t.posts, ["date"]).withColumn("date", day_text())


@query("user_daily_stats", f"""
WITH received AS ({_RECEIVED}),
made AS (
  SELECT user_id, date, count(*) AS statuses_count, count_if(rt_user_id <> 0) AS rts_count,
         count_if(quote_user_id <> 0) AS quotes_count, count_if(reply_user_id <> 0) AS replies_count,
         count_if(rt_user_id = 0 AND quote_user_id = 0 AND reply_user_id = 0) AS plain_count
  FROM posts GROUP BY user_id, date)
SELECT m.* REPLACE (CAST(m.date AS VARCHAR) AS date), coalesce(rts_received, 0) AS rts_received,
       coalesce(quotes_received, 0) AS quotes_received, coalesce(replies_received, 0) AS replies_received,
       p.followers_count, p.friends_count, p.statuses_count AS profile_statuses_count
FROM made m LEFT JOIN received r ON r.user_id = m.user_id AND r.date = m.date
JOIN profiles p ON p.user_id = m.user_id AND p.date = m.date""", ["posts", "profiles"])
def user_daily_stats(t):
    return daily.user_daily_stats(t.posts, t.profiles).withColumn("date", day_text())


@query("distinct_counts", """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS authors, count(DISTINCT user_location) AS places FROM located""",
       ["located"])
def distinct_counts(t):
    return daily.distinct_counts(t.located, authors="user_id", places="user_location")
