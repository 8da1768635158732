"""Queries over scans, sources, sinks and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agorasift.functions import dates as D
from agorasift.functions import text as T
from agorasift.functions import urls as U
from agorasift.operators import daily
from agorasift.operators.durable import scratch_path
from agorasift.plans import views as V
from agorasift.plans.registry import Tables, query
from agorasift.sources import days, files, filters, posts as P
from agorasift.streaming import ingest as S

ZONE = "America/Santiago"


def raw_posts(t: Tables, texts: bool = True, quoted_texts: bool = True) -> DataFrame:
    """Linked posts as nested records; ``file`` is the day, ``line`` the id.

    Without ``texts`` the records have no text fields, for queries that read
    none, and without ``quoted_texts`` quoted posts have none: columns inside
    a record that is tested for null are not pruned.
    """
    date_text = "'Sat' MMM dd HH:mm:ss Z yyyy"  # the day name is not read

    def entities(prefix: str):
        return F.struct(
            F.array(F.struct(F.col(f"{prefix}url").alias("expanded_url")),
                    F.struct(F.lit("").alias("expanded_url"))).alias("urls"),
            F.array(F.struct((F.col(f"{prefix}user_id") + 1).alias("id")),
                    F.struct(F.lit(0).cast("long").alias("id"))).alias("user_mentions"),
            F.array(F.struct(F.col(f"{prefix}lang").alias("text")), F.struct(F.lit("").alias("text"))).alias("hashtags"),
        )

    def body(prefix: str, reply: bool):
        author = F.col(f"{prefix}user_id")
        user = F.struct(
            author.alias("id"),
            *[F.concat(F.lit(f"{f} "), author).alias(f) for f in P.USER_TEXTS if f not in ("url", "created_at")],
            F.lit(None).cast("string").alias("url"),
            F.lit("Sat Jan 01 11:27:55 +0000 2022").alias("created_at"),
            *[(author * (n + 1)).alias(f) for n, f in enumerate(P.USER_COUNTS)],
            *[F.lit(False).alias(f) for f in P.USER_FLAGS],
        )
        full_text = [F.concat(F.lit(">> "), F.col(f"{prefix}text")).alias("full_text")] if texts else []
        extended = F.struct(*full_text, entities(prefix).alias("entities"))
        none = F.lit(None).cast("long")
        return [
            F.col(f"{prefix}id").alias("id"),
            *([F.col(f"{prefix}text").alias("text")] if texts else []),
            F.date_format(F.col(f"{prefix}created_at").cast("timestamp"), date_text).alias("created_at"),
            F.when(F.col(f"{prefix}id") % 11 != 0, F.col(f"{prefix}lang")).alias("lang"),
            user.alias("user"),
            entities(prefix).alias("entities"),
            F.when(F.col(f"{prefix}id") % 5 == 0, extended).alias("extended_tweet"),
            (F.when(F.col("reply_user_id") > 0, F.col("reply_user_id")) if reply else none).alias("in_reply_to_user_id"),
            (F.when(F.col("reply_id") > 0, F.col("reply_id")) if reply else none).alias("in_reply_to_status_id"),
        ]

    reference = body("ref_", False)
    nothing = F.lit(None).cast(P.QUOTED_POST)
    linked = t.linked if quoted_texts or not texts else t.linked_without_quoted
    return linked.select(
        F.col("date").cast("string").alias("file"),
        F.col("id").alias("line"),
        *body("", True),
        F.when(F.col("rt_id") > 0, F.struct(*reference, nothing.alias("quoted_status"))).alias("retweeted_status"),
        F.when(F.col("quote_id") > 0, F.struct(*reference)).alias("quoted_status"),
    )


def write_raw_files(t: Tables, name: str) -> str:
    """The nested posts as compressed lines, among broken and foreign lines."""
    path = scratch_path(t.spark, name)
    raw = raw_posts(t).drop("file", "line")
    good = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    broken = t.events.select(
        F.explode(
            F.array(
                F.concat(F.lit('{"id": '), "event_id"),
                F.concat(F.lit("# "), F.col("props")),
                F.concat(F.lit('{"limit": {"track": '), "event_id", F.lit("}}")),
            )
        ).alias("value")
    )
    good.unionByName(broken).write.option("compression", "gzip").text(path)
    return path


# the full text of a linked post, for the checks
_OWN = "CASE WHEN id % 5 = 0 THEN concat('>> ', text) ELSE text END"
_REF = "CASE WHEN ref_id % 5 = 0 THEN concat('>> ', ref_text) ELSE ref_text END"
_LANG = "CASE WHEN id % 11 = 0 THEN 'und' ELSE lang END"
_FLAT = f"""
SELECT id, user_id, md5(CASE WHEN rt_id > 0 THEN {_REF} ELSE {_OWN} END) AS text_md5, {_LANG} AS lang,
       CASE WHEN rt_id > 0 THEN ref_url ELSE url END AS url,
       CASE WHEN rt_id > 0 THEN CAST(ref_user_id + 1 AS VARCHAR)
            WHEN quote_id > 0 THEN concat(user_id + 1, ',', ref_user_id) ELSE CAST(user_id + 1 AS VARCHAR) END AS mentions,
       CASE WHEN rt_id > 0 THEN ref_lang ELSE lang END AS hashtags,
       rt_id > 0 AS is_retweet, quote_id > 0 AS is_quote, reply_user_id > 0 AS is_reply,
       reply_user_id, reply_id,
       CASE WHEN quote_id > 0 THEN ref_id ELSE 0 END AS quote_id,
       CASE WHEN quote_id > 0 THEN ref_user_id ELSE 0 END AS quote_user_id,
       CASE WHEN rt_id > 0 THEN ref_id ELSE 0 END AS rt_id,
       CASE WHEN rt_id > 0 THEN ref_user_id ELSE 0 END AS rt_user_id,
       user_id * 5 AS user_statuses_count, '' AS user_url FROM linked"""


def flat_view(flat: DataFrame) -> DataFrame:
    return flat.select(
        "id", "user_id", F.md5("text").alias("text_md5"), "lang", F.array_join("urls", ",").alias("url"),
        F.array_join(F.col("mentions").cast("array<string>"), ",").alias("mentions"),
        F.array_join("hashtags", ",").alias("hashtags"), "is_retweet", "is_quote", "is_reply", "reply_user_id",
        "reply_id", "quote_id", "quote_user_id", "rt_id", "rt_user_id", "user_statuses_count", "user_url",
    )


@query("scan_ndjson", _FLAT, ["linked"])
def scan_ndjson(t):
    return flat_view(P.flatten_posts(P.scan_ndjson(t.spark, write_raw_files(t, "scan"))))


@query("scan_corrupt", "SELECT 4 * count(*) AS lines, count(*) AS kept, 3 * count(*) AS skipped FROM events")
def scan_corrupt(t):
    per_file = P.line_quality(t.spark, write_raw_files(t, "corrupt"))
    return per_file.agg(*[F.sum(c).alias(c) for c in ("lines", "kept", "skipped")])


_EXPANDED = f"""
WITH parts AS (
  SELECT CAST(date AS VARCHAR) AS file, id AS line, CASE WHEN rt_id > 0 THEN 0 ELSE 1 END AS position,
         ref_id AS id, ref_user_id AS user_id, md5({_REF}) AS text_md5 FROM linked WHERE rt_id > 0 OR quote_id > 0
  UNION ALL
  SELECT CAST(date AS VARCHAR), id, 2, id, user_id, md5(CASE WHEN rt_id > 0 THEN {_REF} ELSE {_OWN} END) FROM linked)
"""


def expanded_view(df: DataFrame) -> DataFrame:
    return df.select("file", "line", "position", "id", "user_id", F.md5("text").alias("text_md5"))


@query("expand_embedded", _EXPANDED + "SELECT * FROM parts", ["linked"])
def expand_embedded(t):
    return expanded_view(P.expand_embedded(raw_posts(t)))


@query("dedup_first_seen", _EXPANDED + """
SELECT file, line, position, id, user_id, text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY file, id ORDER BY line, position) AS n FROM parts) WHERE n = 1""", ["linked"])
def dedup_first_seen(t):
    return expanded_view(P.dedup_first_seen(P.expand_embedded(raw_posts(t))))


@query("flatten_posts", _FLAT, ["linked"])
def flatten_posts(t):
    return flat_view(P.flatten_posts(raw_posts(t)))


@query("post_text", f"SELECT id, md5(text) AS text_md5, length(text) AS n_chars FROM ("
       f"SELECT id, CASE WHEN rt_id > 0 THEN {_REF} ELSE {_OWN} END AS text FROM linked)", ["linked"])
def post_text(t):
    texts = raw_posts(t, quoted_texts=False).select("id", P.post_text().alias("text"))
    return texts.select("id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("post_mentions", """
SELECT id, user_id + 1 AS mention, 0 AS pos FROM linked WHERE rt_id = 0
UNION ALL SELECT id, ref_user_id + 1, 0 FROM linked WHERE rt_id > 0
UNION ALL SELECT id, ref_user_id, 1 FROM linked WHERE quote_id > 0""", ["linked"])
def post_mentions(t):
    return raw_posts(t, texts=False).select("id", F.posexplode(P.post_mentions()).alias("pos", "mention"))


@query("post_hashtags", "SELECT id, CASE WHEN rt_id > 0 THEN ref_lang ELSE lang END AS hashtag FROM linked", ["linked"])
def post_hashtags(t):
    return raw_posts(t, texts=False).select("id", F.explode(P.post_hashtags()).alias("hashtag"))


@query("post_urls", "SELECT id, CASE WHEN rt_id > 0 THEN ref_url ELSE url END AS url FROM linked", ["linked"])
def post_urls(t):
    return raw_posts(t, texts=False).select("id", F.explode(P.post_urls()).alias("url"))


@query("language_filter", """
SELECT id, lang FROM (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE lang END AS lang FROM posts)
WHERE lang IS NULL OR lang IN ('es', 'fr')""", ["posts"])
def language_filter(t):
    posts = t.posts.select("id", F.when(F.col("id") % 11 != 0, F.col("lang")).alias("lang"))
    return P.keep_languages(posts, ["es", "fr"])


@query("ingest_counts", _EXPANDED.replace("ref_user_id AS user_id", "ref_user_id AS user_id, CASE WHEN ref_id % 11 = 0 THEN 'und' ELSE ref_lang END AS lang")
       .replace("2, id, user_id,", f"2, id, user_id, {_LANG},") + """
SELECT file, count(*) AS total, count(*) FILTER (WHERE lang IN ('en', 'und')) AS written FROM parts GROUP BY file""",
       ["linked"])
def ingest_counts(t):
    expanded = P.expand_embedded(raw_posts(t))
    kept = P.keep_languages(expanded, ["en", "und"])
    target = scratch_path(t.spark, "flat")
    files.write_ingest(kept, target)
    written = t.spark.read.schema(kept.schema).json(target)
    return files.ingest_counts(expanded, written)


@query("json_to_parquet", """
SELECT id, user_id, md5(text) AS text_md5, lang, url, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM posts""", ["posts"])
def json_to_parquet(t):
    posts = t.posts.select("id", "user_id", "text", "lang", "url", F.col("created_at").cast("timestamp"))
    source, target = scratch_path(t.spark, "json"), scratch_path(t.spark, "parquet")
    files.write_json(posts, source)
    days.json_to_parquet(t.spark, source, target, posts.schema)
    return t.spark.read.parquet(target).select(
        "id", "user_id", F.md5("text").alias("text_md5"), "lang", "url",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query("import_day", """
SELECT id, user_id, CAST(CAST(created_at - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS local_date FROM posts
WHERE CAST(created_at - INTERVAL 3 HOUR AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-11'""", ["posts"])
def import_day(t):
    chosen = days.import_day(t.posts, "2024-01-09", ZONE, days=3)
    return chosen.select("id", "user_id", D.local_day(F.col("created_at"), ZONE).cast("string").alias("local_date"))


@query("import_files", "SELECT id, user_id, md5(text) AS text_md5, 'batch-1' AS target FROM posts", ["posts"])
def import_files(t):
    paths = [scratch_path(t.spark, "part") for _ in range(2)]
    early = F.col("date") < F.lit("2024-01-15").cast("date")
    for path, half in zip(paths, (early, ~early)):
        files.write_parquet(t.posts.where(half).select("id", "user_id", "text"), path)
    target = scratch_path(t.spark, "imported")
    days.import_files(t.spark, paths, "batch-1").write.partitionBy("target").parquet(target)
    return t.spark.read.parquet(target).select("id", "user_id", F.md5("text").alias("text_md5"), "target")


GAZETTEER = ("NATION_1;ES", "nation_2", "", "NATION_7;CL")
PLACES_OUT = ("nation_13", "NATION_2[0-2]")


@query("location_filter", """
SELECT id, user_location FROM located WHERE regexp_matches(user_location, '(?i)NATION_1|nation_2|NATION_7')
AND NOT regexp_matches(user_location, '(?i)nation_13|NATION_2[0-2]')""", ["located"])
def location_filter(t):
    kept = filters.import_filter(t.located, patterns=GAZETTEER, blacklist=PLACES_OUT, accept_unknown=False)
    return kept.select("id", "user_location")


@query("account_allowlist", """
SELECT id, user_id, user_location FROM located WHERE user_id IN (1, 2, 3)
OR regexp_matches(user_location, '(?i)NATION_7')""", ["located"])
def account_allowlist(t):
    kept = filters.import_filter(t.located, patterns=["NATION_7"], accept_unknown=False, allowed=[1, 2, 3])
    return kept.select("id", "user_id", "user_location")


@query("keyword_filter", """
SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'ción'))
AND NOT contains(lower(text), 'http') AND NOT contains(lower(text), '@')""")
def keyword_filter(t):
    test = filters.keyword_test(F.col("text"), ["the ", "ción", "@"], ["http", "@"])
    return t.documents.where(test).select("doc_id")


@query("url_blacklist", f"""
SELECT id, url FROM posts WHERE {V.HOST.format('url')} NOT IN ('free-bets.example.com', 'casino-win.example.com')""", ["posts"])
def url_blacklist(t):
    listed = t.spark.createDataFrame([("free-bets.example.com",), ("casino-win.example.com",)], "domain string")
    return filters.drop_link_domains(t.posts.select("id", "url"), listed)


@query("import_tokens", """
SELECT p.user_id, CAST(p.date AS VARCHAR) AS date, p.name_tokens, w.n_tokens, w.tokens_md5
FROM (SELECT user_id, date, concat('customer #', substr(name, 10)) AS name_tokens,
             user_id * 7 % (SELECT count(*) FROM documents) AS dk FROM profiles) p
LEFT JOIN (SELECT doc_id, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY pos)) AS tokens_md5
           FROM doc_words GROUP BY doc_id) w ON w.doc_id = p.dk""", ["profiles", "doc_words"])
def import_tokens(t):
    named = t.profiles.select("user_id", "date", "name", "description")
    tokens = filters.add_tokens(named, {"name": "name_tokens", "description": "tokens"})
    return tokens.select(
        "user_id", F.col("date").cast("string").alias("date"), F.array_join("name_tokens", " ").alias("name_tokens"),
        F.nullif(F.size("tokens").cast("long"), F.lit(0)).alias("n_tokens"),
        F.when(F.size("tokens") > 0, F.md5(F.array_join("tokens", " "))).alias("tokens_md5"),
    )


@query("parse_dates", """
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS instant,
       strftime(created_at - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM posts""", ["posts"])
def parse_dates(t):
    instant = F.col("created_at").cast("timestamp")
    written = F.when(F.col("id") % 2 == 0, F.date_format(instant, "'Sat' MMM dd HH:mm:ss Z yyyy")).otherwise(
        F.date_format(instant, "yyyy-MM-dd HH:mm:ss")
    )
    parsed = t.posts.select("id", D.parse_post_date(written).alias("at"))
    return parsed.select(
        "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("instant"),
        F.date_format(D.local_time(F.col("at"), ZONE), "yyyy-MM-dd HH:mm:ss").alias("local"),
    )


def _days_table(t: Tables, columns=("id", "user_id", "date")) -> str:
    path = scratch_path(t.spark, "days")
    days.write_days(t.posts.select(*columns), path)
    return path


@query("daily_file_summary", """
SELECT CAST(date AS VARCHAR) AS date, count(*) AS n_posts, count(DISTINCT user_id) AS n_users FROM posts GROUP BY date""",
       ["posts"])
def daily_file_summary(t):
    table = t.spark.read.parquet(_days_table(t)).withColumn("path", F.col("_metadata.file_path"))
    summary = days.summarise_days(
        table.drop("date"), F.col("path"), n_posts=F.count(F.lit(1)), n_users=F.countDistinct("user_id")
    )
    return summary.withColumn("date", F.col("date").cast("string"))


@query("incremental_days", """
SELECT CAST(date AS VARCHAR) AS date, count(*) AS n_posts,
       CAST(sum(CASE WHEN date < DATE '2024-01-10' THEN 1 WHEN date < DATE '2024-01-20' THEN 2 ELSE 3 END) AS BIGINT) AS marks
FROM posts GROUP BY date""", ["posts"])
def incremental_days(t):
    path = scratch_path(t.spark, "days")
    posts = t.posts.select("id", "date")
    day = lambda text: F.lit(text).cast("date")
    days.write_days(posts.where(F.col("date") < day("2024-01-20")).withColumn("mark", F.lit(1)), path)
    # days that exist are skipped, the others added
    days.write_days(posts.withColumn("mark", F.lit(3)), path)
    # an overwrite replaces the given days only
    days.write_days(posts.where(F.col("date").between(day("2024-01-10"), day("2024-01-19"))).withColumn("mark", F.lit(2)),
                    path, overwrite=True)
    return t.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum("mark").alias("marks")
    )


@query("read_days", "SELECT id, user_id, CAST(date AS VARCHAR) AS date FROM posts", ["posts"])
def read_days(t):
    return days.read_days(t.spark, _days_table(t)).select("id", "user_id", F.col("date").cast("string").alias("date"))


@query("experiment_slice", """
SELECT id, user_id, CAST(date AS VARCHAR) AS date FROM posts WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-21'""",
       ["posts"])
def experiment_slice(t):
    table = days.read_days(t.spark, _days_table(t), "2024-01-05", "2024-01-21")
    return table.select("id", "user_id", F.col("date").cast("string").alias("date"))


@query("parquet_roundtrip", "SELECT id, user_id, md5(text) AS text_md5, url FROM posts", ["posts"])
def parquet_roundtrip(t):
    path = scratch_path(t.spark, "plain")
    files.write_parquet(t.posts.select("id", "user_id", "text", "url"), path)
    return t.spark.read.parquet(path).select("id", "user_id", F.md5("text").alias("text_md5"), "url")


@query("annotations_merge", """
SELECT reported_label AS class, user_id, concat('user', user_id) AS screen_name FROM predictions
WHERE reported_label IS NOT NULL
UNION ALL SELECT predicted_class, user_id, concat('user', user_id) FROM predictions WHERE predicted_class = 'noise'""",
       ["predictions"])
def annotations_merge(t):
    rows = t.predictions.withColumn("screen_name", F.concat(F.lit("user"), "user_id"))
    first, second = scratch_path(t.spark, "annotations"), scratch_path(t.spark, "annotations")
    old = rows.where(F.col("reported_label").isNotNull()).select(
        F.col("reported_label").alias("class"), "user_id", "screen_name")
    new = rows.where(F.col("predicted_class") == "noise").select(
        F.col("predicted_class").alias("class"), "user_id", "screen_name")
    files.merge_annotations(t.spark, None, old, first)
    files.merge_annotations(t.spark, first, new, second)
    return files.read_csv(t.spark, second, new.schema)


@query("report_sinks", """
SELECT user_id, dataset_posts, round(p_alpha, 6) AS p_alpha, predicted_class, s AS sink
FROM predictions, (VALUES ('csv'), ('json')) v(s)""", ["predictions"])
def report_sinks(t):
    rows = t.predictions.select("user_id", "dataset_posts", F.round("p_alpha", 6).alias("p_alpha"), "predicted_class")
    as_json, as_csv = scratch_path(t.spark, "json"), scratch_path(t.spark, "csv")
    files.write_json(rows, as_json)
    files.write_csv(rows, as_csv)
    return t.spark.read.schema(rows.schema).json(as_json).withColumn("sink", F.lit("json")).unionByName(
        files.read_csv(t.spark, as_csv, rows.schema).withColumn("sink", F.lit("csv"))
    )


@query("term_list", f"""
SELECT DISTINCT {V.HOST.format('url')} AS term FROM pages WHERE {V.HOST.format('url')} <> ''""")
def term_list(t):
    path = scratch_path(t.spark, "terms")
    lines = t.pages.select(F.concat(U.domain(F.col("url")), F.lit(";"), F.col("page_id")).alias("value"))
    lines.write.text(path)
    return filters.term_list(t.spark, path)


@query("csv_scan", "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def csv_scan(t):
    path = scratch_path(t.spark, "csv")
    rows = t.documents.select("doc_id", "text", "lang", "n_chars")
    files.write_csv(rows, path)
    return files.read_csv(t.spark, path, rows.schema).select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")
