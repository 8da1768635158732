"""Views over the given tables that both engines share, as one SQL text each.

They shape events, documents, pages, customers and nations into posts and
profiles.  Texts are whole documents.  Ids are shifted by one since 0 means
'none'.  A click is a repeated post, a view a quote, an error a reply.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FACT_TABLES = ("events", "documents")

# Feature families in the order of their columns.
FEATURE_FAMILIES = (
    "domain", "profile_domain", "profile_tld", "tweet_tokens", "user_name", "description_token", "rt_target", "reply_target",
    "quote_target", "rt_group", "mention_group", "quote_group", "embedding",
)
# Fixed values used by the example rules.
STOPWORDS = ("of", "and", "by", "in", "un", "en")


@dataclass(frozen=True)
class View:
    text: str  # inputs in braces

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", self.text)))


def _values(columns: str, rows: Sequence[tuple]) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


VIEWS: dict[str, View] = {
    "posts": View("""
SELECT e.event_id + 1 AS id, e.user_id + 1 AS user_id, e.ts AS created_at, CAST(e.ts AS DATE) AS date,
       d.text AS text, d.lang AS lang, g.url AS url,
       CASE WHEN e.event_type = 'click' THEN 1000000 + e.k * 10 + e.event_id % 10 ELSE 0 END AS rt_id,
       CASE WHEN e.event_type = 'click' THEN e.k + 1 ELSE 0 END AS rt_user_id,
       CASE WHEN e.event_type = 'view'  THEN 1000000 + e.k * 10 + e.event_id % 10 ELSE 0 END AS quote_id,
       CASE WHEN e.event_type = 'view'  THEN e.k + 1 ELSE 0 END AS quote_user_id,
       CASE WHEN e.event_type = 'error' THEN 1000000 + e.k * 10 + e.event_id % 10 ELSE 0 END AS reply_id,
       CASE WHEN e.event_type = 'error' THEN e.k + 1 ELSE 0 END AS reply_user_id
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
             event_id % (SELECT count(*) FROM {documents}) AS dk,
             event_id % (SELECT count(*) FROM {pages}) AS gk FROM {events}) e
JOIN {documents} d ON d.doc_id = e.dk
JOIN {pages} g ON g.page_id = e.gk"""),
    "profiles": View("""
SELECT a.user_id, a.date, c.c_name AS name, concat('user', CAST(a.user_id AS VARCHAR(20))) AS screen_name,
       d.text AS description, t.n_name AS location, g.url AS url,
       CAST(floor(abs(c.c_acctbal)) AS BIGINT) + a.n_posts AS followers_count,
       a.user_id * 3 % 500 AS friends_count, a.user_id * 11 + a.n_posts AS statuses_count,
       DATE '2015-01-01' + CAST(a.user_id AS INTEGER) AS created_at
FROM (SELECT *, user_id * 7 % (SELECT count(*) FROM {documents}) AS dk,
             user_id % (SELECT count(*) FROM {pages}) AS gk
      FROM (SELECT user_id + 1 AS user_id, CAST(ts AS DATE) AS date, count(*) AS n_posts
            FROM {events} GROUP BY user_id + 1, CAST(ts AS DATE)) b) a
JOIN {customer} c ON c.c_custkey = a.user_id - 1
JOIN {nation} t ON t.n_nationkey = c.c_nationkey
JOIN {documents} d ON d.doc_id = a.dk
JOIN {pages} g ON g.page_id = a.gk"""),
    # every event as an edge of its layer, by day
    "edges": View("""
SELECT CAST(ts AS DATE) AS date,
       CASE event_type WHEN 'click' THEN 'retweet' WHEN 'view' THEN 'quote' ELSE 'reply' END AS layer,
       user_id + 1 AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS dst, count(*) AS weight
FROM {events} WHERE event_type IN ('click', 'view', 'error')
GROUP BY CAST(ts AS DATE),
         CASE event_type WHEN 'click' THEN 'retweet' WHEN 'view' THEN 'quote' ELSE 'reply' END,
         user_id + 1, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1"""),
    "users": View("SELECT user_id + 1 AS user_id, count(*) AS dataset_posts FROM {events} GROUP BY user_id + 1"),
    "stopwords": View(_values("token", [(w,) for w in STOPWORDS])),
    "known_accounts": View(_values("user_id, class", [
        (1, "alpha"), (2, "alpha"), (3, "alpha"), (4, "beta"), (5, "beta")])),
    # label rules: wanted and unwanted tokens per class and feature family
    "rules": View(_values("class, family, kind, token", [
        ("alpha", "description_token", "must_have", "the"), ("alpha", "description_token", "must_have", "that"),
        ("alpha", "description_token", "cant_have", "und"), ("beta", "description_token", "must_have", "und"),
        ("beta", "description_token", "must_have", "der"), ("beta", "description_token", "cant_have", "that"),
        ("noise", "description_token", "must_have", "que"), ("alpha", "rt_target", "must_have", "7"),
        ("beta", "rt_target", "must_have", "13"), ("beta", "rt_target", "cant_have", "7"),
        ("beta", "user_name", "must_have", "#000000008"), ("alpha", "reply_target", "must_have", "21"),
        ("beta", "quote_target", "must_have", "9"), ("noise", "tweet_tokens", "must_have", "worthlessness"),
        ("noise", "profile_domain", "must_have", "free-bets.example.com"), ("noise", "profile_tld", "must_have", "zip"),
        ("noise", "domain", "must_have", "free-bets.example.com")])),
    # class probabilities, one row per user
    "scores": View("""
SELECT user_id, dataset_posts, CAST(user_id * 37 % 100 AS DOUBLE) / 100 AS p_alpha,
       1 - CAST(user_id * 37 % 100 AS DOUBLE) / 100 AS p_beta FROM {users}"""),
    "predictions": View("""
SELECT s.user_id, s.dataset_posts, s.p_alpha, s.p_beta, k.class AS reported_label,
       CASE WHEN k.class IS NOT NULL THEN k.class WHEN s.user_id % 17 = 0 THEN 'noise'
            WHEN greatest(s.p_alpha, s.p_beta) < 0.6 THEN 'undisclosed'
            WHEN s.p_alpha >= s.p_beta THEN 'alpha' ELSE 'beta' END AS predicted_class
FROM {scores} s LEFT JOIN {known_accounts} k ON k.user_id = s.user_id"""),
    "two_classes": View("""
SELECT user_id, CASE WHEN p_alpha >= p_beta THEN 'alpha' ELSE 'beta' END AS predicted_class FROM {scores}"""),
    # a second grouping of the same users
    "ages": View("""
SELECT user_id, CASE WHEN user_id % 13 = 0 THEN 'noise' WHEN user_id % 3 = 0 THEN 'young' ELSE 'old' END
       AS predicted_class FROM {users}"""),
    # each post next to the post it repeats or quotes
    "linked": View("""
SELECT p.id, p.user_id, p.created_at, p.date, p.text, p.lang, p.url, p.rt_id, p.quote_id, p.reply_id,
       p.reply_user_id, r.id AS ref_id, r.user_id AS ref_user_id, r.text AS ref_text, r.lang AS ref_lang,
       r.url AS ref_url, r.created_at AS ref_created_at
FROM (SELECT *, CASE WHEN rt_id > 0 OR quote_id > 0 THEN id * 13 % (SELECT count(*) FROM {events}) + 1 END AS ref_key
      FROM {posts}) p
LEFT JOIN {posts} r ON r.id = p.ref_key"""),
    "located": View("""
SELECT p.*, t.n_name AS user_location FROM {posts} p
JOIN {customer} c ON c.c_custkey = p.user_id - 1 JOIN {nation} t ON t.n_nationkey = c.c_nationkey"""),
    "coords": View("""
SELECT event_id + 1 AS id, CAST((event_id + 1) * 7919 % 18000 AS DOUBLE) / 100 - 90 AS lat,
       CAST((event_id + 1) * 104729 % 36000 AS DOUBLE) / 100 - 180 AS lon FROM {events}"""),
    "boxes": View(_values("name, lat0, lat1, lon0, lon1", [
        (f"r{i}{j}", -75 + 50 * i, -25 + 50 * i, -150 + 100 * j, -50 + 100 * j)
        for i in range(3) for j in range(3)])),
    "emotion_lexicon": View(_values("token, label, weight", [
        ("the", "joy", 0.02), ("that", "sadness", 0.05), ("was", "fear", 0.07), ("und", "anger", 0.03),
        ("que", "joy", 0.04), ("le", "fear", 0.03), ("der", "sadness", 0.02), ("this", "anger", 0.06),
        ("la", "joy", 0.01), ("from", "sadness", 0.08)]).replace("*", "token, label, CAST(weight AS DOUBLE) AS weight")),
}

# The same rows for Spark, with the texts joined last: rows are matched by their
# keys first, so no exchange of another join carries a text.  A row without a
# reference gets a key of its own that matches nothing, since all rows under
# the null key would meet in one task.
SPARK_VIEWS: dict[str, View] = {
    "post_keys": View("""
SELECT e.event_id + 1 AS id, e.user_id + 1 AS user_id, e.ts AS created_at, CAST(e.ts AS DATE) AS date, g.url AS url,
       CASE WHEN e.event_type = 'click' THEN 1000000 + e.k * 10 + e.event_id % 10 ELSE 0 END AS rt_id,
       CASE WHEN e.event_type = 'click' THEN e.k + 1 ELSE 0 END AS rt_user_id,
       CASE WHEN e.event_type = 'view'  THEN 1000000 + e.k * 10 + e.event_id % 10 ELSE 0 END AS quote_id,
       CASE WHEN e.event_type = 'view'  THEN e.k + 1 ELSE 0 END AS quote_user_id,
       CASE WHEN e.event_type = 'error' THEN 1000000 + e.k * 10 + e.event_id % 10 ELSE 0 END AS reply_id,
       CASE WHEN e.event_type = 'error' THEN e.k + 1 ELSE 0 END AS reply_user_id, e.dk AS dk
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
             event_id % (SELECT count(*) FROM {documents}) AS dk,
             event_id % (SELECT count(*) FROM {pages}) AS gk FROM {events}) e
JOIN {pages} g ON g.page_id = e.gk"""),
    "posts": View("""
SELECT p.id, p.user_id, p.created_at, p.date, d.text AS text, d.lang AS lang, p.url, p.rt_id, p.rt_user_id,
       p.quote_id, p.quote_user_id, p.reply_id, p.reply_user_id
FROM {post_keys} p JOIN {documents} d ON d.doc_id = p.dk"""),
    "located": View("""
SELECT p.id, p.user_id, p.created_at, p.date, d.text AS text, d.lang AS lang, p.url, p.rt_id, p.rt_user_id,
       p.quote_id, p.quote_user_id, p.reply_id, p.reply_user_id, t.n_name AS user_location
FROM {post_keys} p JOIN {customer} c ON c.c_custkey = p.user_id - 1 JOIN {nation} t ON t.n_nationkey = c.c_nationkey
JOIN {documents} d ON d.doc_id = p.dk"""),
    "profile_keys": View("""
SELECT a.user_id, a.date, c.c_name AS name, concat('user', CAST(a.user_id AS VARCHAR(20))) AS screen_name,
       t.n_name AS location, g.url AS url,
       CAST(floor(abs(c.c_acctbal)) AS BIGINT) + a.n_posts AS followers_count,
       a.user_id * 3 % 500 AS friends_count, a.user_id * 11 + a.n_posts AS statuses_count,
       DATE '2015-01-01' + CAST(a.user_id AS INTEGER) AS created_at, a.dk AS dk
FROM (SELECT *, user_id * 7 % (SELECT count(*) FROM {documents}) AS dk,
             user_id % (SELECT count(*) FROM {pages}) AS gk
      FROM (SELECT user_id + 1 AS user_id, CAST(ts AS DATE) AS date, count(*) AS n_posts
            FROM {events} GROUP BY user_id + 1, CAST(ts AS DATE)) b) a
JOIN {customer} c ON c.c_custkey = a.user_id - 1
JOIN {nation} t ON t.n_nationkey = c.c_nationkey
JOIN {pages} g ON g.page_id = a.gk"""),
    "profiles": View("""
SELECT p.user_id, p.date, p.name, p.screen_name, d.text AS description, p.location, p.url, p.followers_count,
       p.friends_count, p.statuses_count, p.created_at
FROM {profile_keys} p JOIN {documents} d ON d.doc_id = p.dk"""),
    # keys of posts that have a text
    "told_keys": View("SELECT k.* FROM {post_keys} k LEFT SEMI JOIN {documents} d ON d.doc_id = k.dk"),
    "linked_keys": View("""
SELECT p.*, r.id AS ref_id, r.user_id AS ref_user_id, r.url AS ref_url, r.created_at AS ref_created_at, r.dk AS ref_dk
FROM (SELECT *, CASE WHEN rt_id > 0 OR quote_id > 0 THEN id * 13 % (SELECT count(*) FROM {events}) + 1 END AS ref_key
      FROM {post_keys}) p
LEFT JOIN {told_keys} r ON r.id = coalesce(p.ref_key, -p.id) AND p.ref_key IS NOT NULL"""),
    "linked": View("""
SELECT p.id, p.user_id, p.created_at, p.date, d.text AS text, d.lang AS lang, p.url, p.rt_id, p.quote_id, p.reply_id,
       p.reply_user_id, p.ref_id, p.ref_user_id, q.text AS ref_text, q.lang AS ref_lang, p.ref_url, p.ref_created_at
FROM {linked_keys} p
LEFT JOIN {documents} q ON q.doc_id = coalesce(p.ref_dk, -p.id) AND p.ref_dk IS NOT NULL
JOIN {documents} d ON d.doc_id = p.dk"""),
    # for queries that read no quoted text: only a repeated post's text goes to the join of the own texts
    "linked_without_quoted": View("""
SELECT p.id, p.user_id, p.created_at, p.date, d.text AS text, d.lang AS lang, p.url, p.rt_id, p.quote_id, p.reply_id,
       p.reply_user_id, p.ref_id, p.ref_user_id, p.ref_text, p.ref_lang, p.ref_url, p.ref_created_at
FROM (SELECT k.*, CASE WHEN k.rt_id > 0 THEN q.text END AS ref_text, q.lang AS ref_lang FROM {linked_keys} k
      LEFT JOIN {documents} q ON q.doc_id = coalesce(k.ref_dk, -k.id) AND k.ref_dk IS NOT NULL) p
JOIN {documents} d ON d.doc_id = p.dk"""),
}

# Views whose SQL differs between the engines are given for the check only; the
# Spark side computes them with the library.
TOKEN_PATTERN = (
    r"https?://[^\s]+|[@#][\p{L}\p{N}_]+|[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]+"
)
PUNCTUATION_PATTERN = r"^[\p{P}\p{Sm}\p{Sc}\p{Sk}]+$"


def clean(column: str = "token") -> str:
    return f"NOT regexp_matches({column}, '{PUNCTUATION_PATTERN}') AND NOT regexp_matches({column}, '^https?://')"


HOST = (
    r"lower(regexp_replace(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), "
    r"'^(?:w+|web|open|m|s|i|es|amp|\w{{2}}-\w{{2}}|ar|cl|profile|my|mobile)\.', ''))"
)
DISCARDED = "('', 'twitter.com', 'bit.ly', 'ow.ly', 'buff.ly', 'fb.me', 'goo.gl', 'g.co')"

CHECK_VIEWS: dict[str, str] = {
    "doc_words": f"""
SELECT doc_id, lang, pos, token FROM (
  SELECT doc_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
  FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS tokens FROM documents))
WHERE {clean()}""",
    "post_words": """
SELECT p.id, p.user_id, p.date, w.token
FROM (SELECT event_id + 1 AS id, user_id + 1 AS user_id, CAST(ts AS DATE) AS date,
             event_id % (SELECT count(*) FROM documents) AS dk FROM events) p
JOIN doc_words w ON w.doc_id = p.dk""",
    "user_tokens": "SELECT user_id, token, count(*) AS frequency FROM post_words GROUP BY 1, 2",
    # words and pairs of neighbours; the bits of a hash as signs, scaled to length one, in steps of 2 ** -20
    "doc_vectors": """
SELECT doc_id, pos, CAST(floor(x / sqrt(CAST(sum(x * x) OVER (PARTITION BY doc_id) AS DOUBLE)) * 1048576 + 0.5) AS BIGINT) AS steps
FROM (SELECT doc_id, pos, CAST(sum(n * (2 * (((instr('0123456789abcdef', substr(h, pos // 4 + 1, 1)) - 1) >> (3 - pos % 4)) & 1) - 1))
             AS BIGINT) AS x
      FROM (SELECT doc_id, md5(concat('7:', gram)) AS h, count(*) AS n FROM (
              SELECT doc_id, token AS gram FROM doc_words UNION ALL
              SELECT doc_id, concat(token, ' ', lead(token) OVER (PARTITION BY doc_id ORDER BY pos)) FROM doc_words
              QUALIFY lead(token) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL) GROUP BY 1, 2),
           (SELECT CAST(unnest(range(64)) AS INTEGER) AS pos)
      GROUP BY 1, 2)""",
    "user_vectors": """
SELECT c.user_id, c.pos, floor(coalesce(s.steps, 0) / CAST(c.n AS DOUBLE) + 0.5) / 1048576 AS value
FROM (SELECT user_id, pos, n FROM (SELECT user_id, count(*) AS n FROM posts GROUP BY 1),
           (SELECT CAST(unnest(range(64)) AS INTEGER) AS pos)) c
LEFT JOIN (SELECT p.user_id, v.pos, CAST(CAST(sum(v.steps) AS BIGINT) AS DOUBLE) AS steps FROM (
             SELECT event_id % (SELECT count(*) FROM documents) AS dk, user_id + 1 AS user_id FROM events) p
           JOIN doc_vectors v ON v.doc_id = p.dk GROUP BY 1, 2) s ON s.user_id = c.user_id AND s.pos = c.pos""",
    "profile_words": """
SELECT p.user_id, p.date, w.token FROM (
  SELECT user_id + 1 AS user_id, CAST(ts AS DATE) AS date, (user_id + 1) * 7 % (SELECT count(*) FROM documents) AS dk
  FROM events GROUP BY 1, 2, 3) p JOIN doc_words w ON w.doc_id = p.dk
JOIN customer c ON c.c_custkey = p.user_id - 1""",
    "multiplex": """
SELECT src, dst, CAST(sum(CASE WHEN layer = 'retweet' THEN weight ELSE 0 END) AS BIGINT) AS retweet,
       CAST(sum(CASE WHEN layer = 'quote' THEN weight ELSE 0 END) AS BIGINT) AS quote,
       CAST(sum(CASE WHEN layer = 'reply' THEN weight ELSE 0 END) AS BIGINT) AS reply,
       CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY 1, 2""",
    "heavy": "SELECT src, dst FROM multiplex WHERE weight >= 2",
    "reach": """
SELECT src AS node, src AS label FROM heavy UNION SELECT dst, dst FROM heavy UNION
SELECT h.b, r.label FROM reach r JOIN (SELECT src AS a, dst AS b FROM heavy UNION SELECT dst, src FROM heavy) h ON h.a = r.node""",
    "components": "SELECT node, min(label) AS component FROM reach GROUP BY node",
    "members": """
SELECT node FROM components WHERE component = (
  SELECT component FROM components GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""",
    "discussion": """
SELECT node FROM (SELECT src AS node FROM heavy UNION ALL SELECT dst FROM heavy)
WHERE node IN (SELECT node FROM members) GROUP BY node HAVING count(*) >= 2""",
    "row_ids": """
SELECT user_id, row_number() OVER (ORDER BY dataset_posts DESC, user_id) - 1 AS row_id FROM users
WHERE user_id IN (SELECT node FROM discussion)""",
    "post_vocab": f"""
SELECT token, frequency, row_number() OVER (ORDER BY frequency DESC, token) - 1 AS token_id FROM (
  SELECT token, CAST(sum(frequency) AS BIGINT) AS frequency FROM user_tokens WHERE token NOT IN {STOPWORDS}
  GROUP BY token HAVING sum(frequency) >= 200)""",
    "description_vocab": f"""
SELECT token, frequency, row_number() OVER (ORDER BY frequency DESC, token) - 1 AS token_id FROM (
  SELECT token, count(*) AS frequency FROM profile_words WHERE token NOT IN {STOPWORDS}
  GROUP BY token HAVING count(*) >= 50)""",
    "profile_hosts": f"""
SELECT DISTINCT user_id, regexp_extract({HOST.format('url')}, '([^.]*\\.)?[^.]*$') AS host FROM profiles WHERE url <> ''""",
    "name_words": f"""
SELECT user_id, token FROM (SELECT user_id, unnest(regexp_extract_all(lower(name), '{TOKEN_PATTERN}')) AS token FROM profiles)
WHERE {clean()}""",
    "features": """
SELECT user_id AS row_id, 'description_token' AS type, token, CAST(count(*) AS DOUBLE) AS value FROM profile_words GROUP BY 1, 2, 3
UNION ALL SELECT user_id, 'user_name', token, CAST(count(*) AS DOUBLE) FROM name_words GROUP BY 1, 2, 3
UNION ALL SELECT user_id, 'tweet_tokens', token, CAST(frequency AS DOUBLE) FROM user_tokens
UNION ALL SELECT user_id, 'domain', domain, CAST(frequency AS DOUBLE) FROM user_domains
UNION ALL SELECT DISTINCT user_id, 'profile_domain', host, 1.0 FROM profile_hosts
UNION ALL SELECT DISTINCT user_id, 'profile_tld', regexp_extract(host, '[^.]*$'), 1.0 FROM profile_hosts
UNION ALL SELECT src, CASE layer WHEN 'retweet' THEN 'rt_target' WHEN 'reply' THEN 'reply_target' ELSE 'quote_target' END,
  CAST(dst AS VARCHAR), CAST(sum(weight) AS DOUBLE) FROM edges GROUP BY 1, 2, 3""",
    "family_labels": """
SELECT f.row_id, r.family, r.class FROM features f JOIN rules r ON r.family = f.type AND r.token = f.token
GROUP BY 1, 2, 3 HAVING count_if(r.kind = 'must_have') > 0 AND count_if(r.kind = 'cant_have') = 0""",
    "votes": "SELECT row_id, class, count(*) AS votes FROM family_labels GROUP BY 1, 2",
    "sure_votes": "SELECT * FROM votes WHERE row_id IN (SELECT row_id FROM votes GROUP BY 1 HAVING count(*) = 1)",
    "tagged_votes": """
SELECT row_id, class, votes FROM sure_votes WHERE row_id NOT IN (SELECT user_id FROM known_accounts)
UNION ALL SELECT user_id, class, 1 FROM known_accounts WHERE user_id IN (SELECT user_id FROM users)""",
    "model_features": """
SELECT row_id, type, token, value FROM features
WHERE (type, token) NOT IN (SELECT (family, token) FROM rules WHERE kind = 'must_have')
UNION ALL SELECT e.src, CASE e.layer WHEN 'retweet' THEN 'rt_group' WHEN 'reply' THEN 'mention_group' ELSE 'quote_group' END, l.class,
  CAST(sum(e.weight) AS DOUBLE) FROM edges e JOIN tagged_votes l ON l.row_id = e.dst GROUP BY 1, 2, 3
UNION ALL SELECT user_id, 'embedding', CAST(pos AS VARCHAR), value FROM user_vectors WHERE value <> 0""",
    "dictionary": f"""
SELECT type, token, matrix_sum, row_number() OVER (ORDER BY block, matrix_sum DESC, token) - 1 AS feature_id FROM (
  SELECT type, token, sum(value) AS matrix_sum,
         list_position({list(FEATURE_FAMILIES)}, type) AS block
  FROM model_features GROUP BY type, token HAVING max(abs(value)) > 0)""",
    "user_domains": f"""
SELECT user_id, domain, count(*) AS frequency FROM (SELECT user_id, {HOST.format('url')} AS domain FROM posts)
WHERE domain NOT IN {DISCARDED} GROUP BY 1, 2""",
    "domain_vocab": """
SELECT domain, frequency, row_number() OVER (ORDER BY frequency DESC, domain) - 1 AS token_id FROM (
  SELECT domain, CAST(sum(frequency) AS BIGINT) AS frequency FROM user_domains GROUP BY 1 HAVING sum(frequency) >= 10)""",
}

_CHECK_INPUTS = {
    "post_words": ("doc_words",), "profile_words": ("doc_words",),
    "user_tokens": ("post_words",), "multiplex": ("edges",), "heavy": ("multiplex",), "reach": ("heavy",),
    "components": ("reach",), "members": ("components",), "discussion": ("heavy", "members"),
    "row_ids": ("users", "discussion"), "post_vocab": ("user_tokens",), "description_vocab": ("profile_words",),
    "profile_hosts": ("profiles",), "name_words": ("profiles",),
    "features": ("profile_words", "name_words", "user_tokens", "user_domains", "profile_hosts", "edges"), "family_labels": ("features", "rules"),
    "votes": ("family_labels",), "sure_votes": ("votes",), "tagged_votes": ("sure_votes", "known_accounts", "users"),
    "doc_vectors": ("doc_words",), "user_vectors": ("posts", "doc_vectors"),
    "model_features": ("features", "rules", "edges", "tagged_votes", "user_vectors"), "dictionary": ("model_features",),
    "user_domains": ("posts",), "domain_vocab": ("user_domains",),
}


def with_views(body: str, names: Sequence[str]) -> str:
    """SQL for the check engine: the needed views, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in BASE_TABLES or name in order:
            return
        for other in VIEWS[name].inputs if name in VIEWS else _CHECK_INPUTS.get(name, ()):
            need(other)
        order.append(name)

    for name in names:
        need(name)
    parts = []
    for name in order:
        text = re.sub(r"[{}]", "", VIEWS[name].text) if name in VIEWS else CHECK_VIEWS[name]
        parts.append(f"{name} AS ({text.strip()})")
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\s+", body)
    if not parts:
        return body.strip()
    head = "WITH RECURSIVE " + ",\n".join(parts)
    return f"{head},\n{body[own.end():].strip()}" if own else f"{head}\n{body.strip()}"
