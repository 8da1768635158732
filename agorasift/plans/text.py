"""Queries over scalar text, date and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorasift.functions import dates as D
from agorasift.functions import numeric as N
from agorasift.functions import text as T
from agorasift.functions import urls as U
from agorasift.operators import columns as C
from agorasift.operators import daily
from agorasift.operators.durable import durable
from agorasift.plans import views as V
from agorasift.plans.registry import query


def _token_rows(df, tokens):
    """Size and digest of each token list, so whole lists are compared."""
    return df.select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _token_sql(keep: str = "true") -> str:
    return f"""
SELECT d.doc_id, count(token) AS n_tokens, md5(coalesce(string_agg(token, ' ' ORDER BY pos), '')) AS tokens_md5
FROM documents d LEFT JOIN (
  SELECT * FROM (
    SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{V.TOKEN_PATTERN}') AS tokens FROM documents))
  WHERE {keep}) w ON w.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("tokenize", _token_sql())
def tokenize(t):
    return _token_rows(t.documents, T.raw_tokens(F.col("text")))


@query("clean_tokens", _token_sql(V.clean()))
def clean_tokens(t):
    return _token_rows(t.documents, T.clean_tokens(T.raw_tokens(F.col("text"))))


@query("stopword_filter", _token_sql(V.clean() + f" AND token NOT IN {V.STOPWORDS}"))
def stopword_filter(t):
    return _token_rows(t.documents, T.tokenize(F.col("text"), stopwords=t.stopwords))


@query("deaccent", "SELECT doc_id, md5(strip_accents(text)) AS text_md5 FROM documents")
def deaccent(t):
    return t.documents.select("doc_id", F.md5(T.deaccent(F.col("text"))).alias("text_md5"))


_PLAIN_WORD = "NOT regexp_matches({0}, '^[@#]') AND NOT regexp_matches({0}, '^\\p{{So}}')"


@query("ngrams", f"""
WITH follow AS (
  SELECT doc_id, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM doc_words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (
  SELECT doc_id, concat(a, ' ', b) AS gram FROM follow
  WHERE b IS NOT NULL AND b NOT IN {V.STOPWORDS} AND {_PLAIN_WORD.format('a')} AND {_PLAIN_WORD.format('b')}
  UNION ALL
  SELECT doc_id, concat(a, ' ', b, ' ', c) FROM follow
  WHERE c IS NOT NULL AND c NOT IN {V.STOPWORDS}
    AND {_PLAIN_WORD.format('a')} AND {_PLAIN_WORD.format('b')} AND {_PLAIN_WORD.format('c')})
SELECT d.doc_id, count(gram) AS n_grams, md5(coalesce(string_agg(gram, '|' ORDER BY gram), '')) AS grams_md5
FROM documents d LEFT JOIN grams g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
       ["doc_words"])
def ngrams(t):
    tokens = T.tokenize(F.col("text"))
    words = t.documents.select("doc_id", tokens.alias("t"))
    grams = words.select("doc_id", F.sort_array(T.ngrams(F.col("t"), 2, 4, t.stopwords)).alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("grams_md5"))


@query("url_domain", f"SELECT page_id, {V.HOST.format('url')} AS domain FROM pages")
def url_domain(t):
    return t.pages.select("page_id", U.domain(F.col("url")).alias("domain"))


# some links are made to point at a shortener
_SHORT = "CASE WHEN page_id % 4 = 0 THEN concat('http://bit.ly/', page_id) ELSE url END"


@query("discard_domains", f"""
SELECT page_id, {V.HOST.format('u')} AS domain FROM (SELECT page_id, {_SHORT} AS u FROM pages)
WHERE {V.HOST.format('u')} NOT IN {V.DISCARDED}""")
def discard_domains(t):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://bit.ly/"), "page_id")).otherwise(F.col("url"))
    return t.pages.select("page_id", U.domain(url).alias("domain")).where(~U.is_discarded(F.col("domain")))


@query("domain_parts", f"""
SELECT page_id, regexp_extract({V.HOST.format('url')}, '([^.]*\\.)?[^.]*$') AS main_domain,
       regexp_extract({V.HOST.format('url')}, '[^.]*$') AS tld FROM pages""")
def domain_parts(t):
    host = U.domain(F.col("url"))
    return t.pages.select("page_id", U.main_domain(host).alias("main_domain"), U.top_level(host).alias("tld"))


@query("split_explode", """
SELECT page_id, unnest(string_split(concat(url, '|', page_id, '|', upper(url)), '|')) AS part FROM pages""")
def split_explode(t):
    joined = F.concat_ws("|", "url", "page_id", F.upper("url"))
    return t.pages.select("page_id", F.explode(F.split(joined, r"\|")).alias("part"))


_BIO = """CASE doc_id % 4 WHEN 0 THEN concat('tengo ', doc_id % 97, ' AÑOS, 50 años. ', text)
 WHEN 1 THEN concat('lvl ', 10 + doc_id % 60, '. ', text) WHEN 2 THEN concat(doc_id % 100, ' years old ', text) ELSE text END"""
_AGE = r"""'(?i)(?:^|level|lvl|nivel)\s?([0-6][0-9])\.|(?:^|[^\p{L}\p{N}_])([0-9]{2})\s?(?:años|veranos|otoños|inviernos|primaveras|years old|vueltas|lunas|soles)'"""
_AGES = f"""
WITH bios AS (SELECT doc_id, {_BIO} AS bio FROM documents),
hits AS (SELECT doc_id, TRY_CAST(regexp_extract(bio, {_AGE}, 1) AS INTEGER) AS a,
                TRY_CAST(regexp_extract(bio, {_AGE}, 2) AS INTEGER) AS b FROM bios),
ages AS (SELECT doc_id, CASE WHEN a >= 10 THEN a WHEN b >= 10 THEN b END AS age FROM hits)
"""


def biography():
    n = F.col("doc_id")
    return (
        F.when(n % 4 == 0, F.concat(F.lit("tengo "), n % 97, F.lit(" AÑOS, 50 años. "), F.col("text")))
        .when(n % 4 == 1, F.concat(F.lit("lvl "), 10 + n % 60, F.lit(". "), F.col("text")))
        .when(n % 4 == 2, F.concat(n % 100, F.lit(" years old "), F.col("text")))
        .otherwise(F.col("text"))
    )


@query("age_extract", _AGES + "SELECT doc_id, CASE WHEN age <= 90 THEN age END AS age FROM ages")
def age_extract(t):
    return t.documents.select("doc_id", T.age_from_biography(biography()).alias("age"))


@query("age_bins", _AGES + """
SELECT doc_id, CASE WHEN age <= 17 THEN '(0,17]' WHEN age <= 29 THEN '(17,29]' WHEN age <= 39 THEN '(29,39]'
  WHEN age <= 49 THEN '(39,49]' WHEN age <= 90 THEN '(49,91]' END AS bin FROM ages""")
def age_bins(t):
    return t.documents.select("doc_id", T.age_bin(T.age_from_biography(biography())).alias("bin"))


@query("digit_count", "SELECT c_custkey, length(regexp_replace(c_name, '[^0-9]', '', 'g')) AS digits FROM customer")
def digit_count(t):
    return t.customer.select("c_custkey", T.digit_count(F.col("c_name")).cast("long").alias("digits"))


_FAMILIES = ("tweet_tokens", "description_token", "user_name", "domain", "profile_domain", "profile_tld", "rt_target",
             "reply_target", "quote_target", "mention_target", "rt_group", "mention_group", "quote_group", "embedding")
_TITLES = ("term", "bio", "name", "link", "bio.link", "bio.tld", "RT", "REPLY", "QUOTE", "REPLY", "RT(group)",
           "MENTION(group)", "QUOTE(group)", "embedding")


@query("feature_type_names", "SELECT event_id, title FROM events JOIN (VALUES "
       + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_TITLES)) + ") v(i, title) ON i = event_id % 14")
def feature_type_names(t):
    names = F.array(*[F.lit(f) for f in _FAMILIES])
    family = F.element_at(names, (F.col("event_id") % 14 + 1).cast("int"))
    return t.events.select("event_id", T.family_title(family).alias("title"))


@query("mask_handles", r"""
WITH words AS (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS pos FROM (
  SELECT doc_id, string_split(concat(text, ' @a @ http://x ', doc_id), ' ') AS parts FROM documents))
SELECT doc_id, md5(string_agg(CASE WHEN starts_with(word, '@') AND length(word) > 1 THEN '@user'
  WHEN starts_with(word, 'http') THEN 'http' ELSE word END, ' ' ORDER BY pos)) AS text_md5 FROM words GROUP BY doc_id""")
def mask_handles(t):
    text = F.concat(F.col("text"), F.lit(" @a @ http://x "), F.col("doc_id"))
    return t.documents.select("doc_id", F.md5(T.mask_handles(text)).alias("text_md5"))


@query("select_prefix", "SELECT user_id, user_location FROM located", ["located"])
def select_prefix(t):
    return C.select_prefix(t.located, "user")


@query("safe_log_ratio", """
SELECT user_id, CAST(date AS VARCHAR) AS date, round(ln(1 + friends_count), 6) AS log_friends,
  round(CASE WHEN followers_count % 50 = 0 THEN 0 ELSE ln(1 + friends_count) / ln(1 + followers_count % 50) END, 6) AS ratio
FROM profiles""", ["profiles"])
def safe_log_ratio(t):
    ratio = N.log_ratio(F.col("friends_count"), F.col("followers_count") % 50)
    return t.profiles.select("user_id", F.col("date").cast("string").alias("date"),
                             F.round(F.log1p("friends_count"), 6).alias("log_friends"), F.round(ratio, 6).alias("ratio"))


@query("account_age", """
SELECT user_id, CAST(date AS VARCHAR) AS date,
  CAST(floor((epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(CAST(created_at AS TIMESTAMP))) / 86400) AS BIGINT) AS age_days
FROM profiles""", ["profiles"])
def account_age(t):
    age = D.days_between(F.lit("2024-02-01 12:00:00"), F.col("created_at"))
    return t.profiles.select("user_id", F.col("date").cast("string").alias("date"), age.alias("age_days"))


@query("numeric_tokens", """
SELECT token, count(*) AS frequency FROM doc_words WHERE NOT regexp_matches(token, '^\\p{N}+$') GROUP BY token""",
       ["doc_words"])
def numeric_tokens(t):
    return daily.token_frequency(t.documents, T.tokenize, text="text").where(~T.is_numeric(F.col("token")))


@query("normalize_rows", """
SELECT user_id, dst, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS value FROM (
  SELECT src AS user_id, dst, CAST(sum(weight) AS DOUBLE) AS n FROM edges GROUP BY 1, 2)""", ["edges"])
def normalize_rows(t):
    coo = t.edges.groupBy(F.col("src").alias("user_id"), "dst").agg(F.sum("weight").alias("value"))
    return C.normalize_rows(coo, "user_id").withColumn("value", F.round("value", 6)).select("user_id", "dst", "value")


@query("zscore_columns", """
SELECT user_id, CAST(date AS VARCHAR) AS date,
  round((followers_count - avg(followers_count) OVER ()) / stddev_pop(followers_count) OVER (), 5) AS followers_count,
  round((statuses_count - avg(statuses_count) OVER ()) / stddev_pop(statuses_count) OVER (), 5) AS statuses_count
FROM profiles""", ["profiles"])
def zscore_columns(t):
    names = ["followers_count", "statuses_count"]
    scaled = C.zscore_columns(t.profiles.select("user_id", F.col("date").cast("string"), *names), names)
    return scaled.select("user_id", "date", *[F.round(c, 5).alias(c) for c in names])


_DESCRIBE = """
SELECT '{0}' AS name, count({0}) AS count, round(avg({0}), 5) AS mean, round(stddev_samp({0}), 5) AS std,
 CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max, quantile_cont(CAST({0} AS DOUBLE), 0.25) AS q25,
 quantile_cont(CAST({0} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({0} AS DOUBLE), 0.75) AS q75 FROM {1}"""


@query("describe_columns", _DESCRIBE.format("followers_count", "profiles") + " UNION ALL "
       + _DESCRIBE.format("statuses_count", "profiles"), ["profiles"])
def describe_columns(t):
    stats = C.describe_columns(t.profiles, ["followers_count", "statuses_count"])
    return stats.withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query("seeded_sample", """
SELECT doc_id, lang FROM documents ORDER BY md5(concat(doc_id, ':42')), doc_id LIMIT 50""")
def seeded_sample(t):
    return C.seeded_sample(t.documents.select("doc_id", "lang"), 50, ["doc_id"])


_HISTOGRAM = """
SELECT '{0}' AS scale, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT {1} AS v, min({1}) OVER () AS lo, max({1}) OVER () AS hi
      FROM (SELECT CAST(count(*) AS DOUBLE) AS f FROM doc_words GROUP BY token)) GROUP BY 1, 2"""


@query("frequency_histogram", _HISTOGRAM.format("raw", "f") + " UNION ALL " + _HISTOGRAM.format("log", "ln(f)"), ["doc_words"])
def frequency_histogram(t):
    words = durable(daily.token_frequency(t.documents, T.tokenize, text="text"))
    raw = C.frequency_histogram(words, "frequency").withColumn("scale", F.lit("raw"))
    return raw.unionByName(C.frequency_histogram(words, "frequency", log=True).withColumn("scale", F.lit("log")))
