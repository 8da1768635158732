"""Hand-made cases for the rules that are easy to get wrong."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from agorasift.functions import dates as D
from agorasift.functions import text as T
from agorasift.functions import urls as U
from agorasift.operators import graph as G
from agorasift.operators import labels as L
from agorasift.operators import ranking as R
from agorasift.operators import scores as S
from agorasift.operators import vocabulary as W
from agorasift.sources import days, files, filters
from agorasift.sources import posts as P


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def user(i):
    return {"id": i, "screen_name": f"u{i}", "description": None, "location": None, "name": "n", "url": None,
            "verified": False, "followers_count": 1, "friends_count": 1, "listed_count": 0, "favourites_count": 0,
            "statuses_count": 1, "created_at": "Sat Jan 01 11:27:55 +0000 2022", "profile_image_url_https": None,
            "default_profile": True, "default_profile_image": False}


def post(i, author, text="hola", **more):
    entities = {"urls": [], "user_mentions": [], "hashtags": []}
    return {"id": i, "text": text, "created_at": "Sat Jan 01 11:27:55 +0000 2022", "user": user(author),
            "entities": entities, "in_reply_to_user_id": None, "in_reply_to_status_id": None, **more}


def write_lines(folder, name, lines):
    import gzip

    folder.mkdir(exist_ok=True)
    with gzip.open(folder / name, "wb") as sink:
        for line in lines:
            sink.write((line if isinstance(line, bytes) else json.dumps(line).encode()) + b"\n")
    return str(folder)


def test_scan_skips_damaged_lines(spark, tmp_path):
    path = write_lines(tmp_path / "in", "a.gz", [
        post(1, 5), b"not json", b'{"id": 2', b'{"id": 3}', b'{"id": 4, "user": \xff\xfe}', post(6, 7)])
    assert [r.id for r in P.scan_ndjson(spark, path).orderBy("line").collect()] == [1, 6]
    quality = P.line_quality(spark, path).first()
    assert (quality["lines"], quality["kept"], quality["skipped"]) == (6, 2, 4)


def test_scan_keeps_rows_before_a_broken_gzip_end(spark, tmp_path):
    path = write_lines(tmp_path / "in", "a.gz", [post(i, 1) for i in range(3)])
    (tmp_path / "in" / "b.gz").write_bytes(b"no gzip at all")
    assert P.scan_ndjson(spark, path).count() == 3


def test_first_seen_per_file(spark, tmp_path):
    repeated = post(9, 2, "original")
    path = write_lines(tmp_path / "in", "a.gz", [post(1, 1, retweeted_status=repeated), repeated, post(1, 1, retweeted_status=repeated)])
    rows = P.dedup_first_seen(P.expand_embedded(P.scan_ndjson(spark, path))).orderBy("line", "position").collect()
    assert [r.id for r in rows] == [9, 1]
    assert [r.text for r in rows] == ["original", "original"]
    assert rows[1].is_retweet and rows[1].rt_id == 9 and rows[1].rt_user_id == 2
    assert rows[0].user_description == "" and rows[0].lang == "und"


def test_flat_row_of_quote_with_extended_text(spark, tmp_path):
    quoted = post(3, 30, "inner")
    extended = {"full_text": "long text", "entities": {
        "urls": [{"expanded_url": "http://a.b/c"}, {"expanded_url": ""}],
        "user_mentions": [{"id": 8}, {"id": 0}, {"id": None}], "hashtags": [{"text": "x"}, {"text": None}]}}
    path = write_lines(tmp_path / "in", "a.gz", [post(4, 40, "short", extended_tweet=extended, quoted_status=quoted, in_reply_to_user_id=77)])
    row = P.flatten_posts(P.scan_ndjson(spark, path)).first()
    assert (row.text, row.urls, row.mentions, row.hashtags) == ("long text", ["http://a.b/c"], [8, 30], ["x"])
    assert (row.is_quote, row.quote_id, row.quote_user_id, row.is_reply, row.reply_user_id, row.rt_id) == (True, 3, 30, True, 77, 0)


def test_keywords_and_allowed_accounts(spark):
    rows = spark.createDataFrame([(1, 5, "Migrantes hoy", "CL"), (2, 6, "Migrantes", "CL")], "id long, user_id long, text string, user_location string")
    kept = lambda **k: [r.id for r in filters.import_filter(rows, **k).collect()]
    assert kept(include=["migrante"], reject=["hoy"]) == [2]
    assert kept(include=["migrante"], reject=["hoy"], allowed=[5]) == [1, 2]
    assert kept(include=["migrante"], reject=["migrante"]) == []
    assert kept(include=["[a-z]+"]) == []
    many = [f"word{i}" for i in range(100)] + ["migrante"]
    assert kept(include=many) == [1, 2]


def test_local_day(spark):
    night = one(spark, D.local_day(F.col("t"), "America/Santiago"), t=datetime.datetime(2022, 1, 1, 2, 30))
    assert night == datetime.date(2021, 12, 31)


def test_post_dates(spark):
    parse = lambda s: one(spark, F.date_format(D.parse_post_date(F.col("s")), "yyyy-MM-dd HH:mm:ss"), s=s)
    assert parse("Sat Jan 01 11:27:55 +0000 2022") == "2022-01-01 11:27:55"
    assert parse("2022-01-01 11:27:55") == "2022-01-01 11:27:55"
    assert parse("yesterday") is None


def test_ngrams(spark):
    tokens = one(spark, T.tokenize(F.col("s"), ngram_range=(2, 3), stopwords=["de"]), s="#tag buen dia de")
    assert tokens == ["#tag", "buen", "dia", "buen dia"]


def test_tokens(spark):
    read = lambda s, **k: one(spark, T.tokenize(F.col("s"), **k), s=s)
    assert read("Hola @Ana! visit https://x.y/Z 😀 l'été 12") == ["hola", "@ana", "visit", "😀", "l'été", "12"]
    assert read("L'été", without_accents=True) == ["l'ete"]
    assert read("http!", lower=False) == ["http"]
    assert read("\\ a") == ["a"]


def test_domains(spark):
    read = lambda u: one(spark, U.domain(F.col("u")), u=u)
    assert [read(u) for u in ("http://es.foo.com:80/x", "//m.twitter.com/a", "foo.com")] == ["foo.com:80", "twitter.com", ""]
    assert one(spark, U.main_domain(F.col("u")), u="a.b.example.co") == "example.co"
    assert one(spark, U.main_domain(F.col("u")), u="localhost") == "localhost"


def test_age(spark):
    read = lambda s: one(spark, T.age_from_biography(F.col("s")), s=s)
    assert read("tengo 25 años, hijo de 50 años") == 25
    assert one(spark, T.age_bin(F.lit(25)), s="x") == "(17,29]"
    assert read("05. algo") is None
    assert read("nada") is None
    assert read("99 years old") is None


def test_conflicting_votes(spark):
    votes = spark.createDataFrame([(1, "alpha", 2), (1, "beta", 1), (2, "beta", 3)], "row_id long, class string, votes long")
    assert [tuple(r) for r in L.drop_conflicts(votes).collect()] == [(2, "beta", 3)]


def test_manual_and_capped_labels(spark):
    votes = spark.createDataFrame([(i, "alpha", 1) for i in range(100)] + [(200, "beta", 1)], "row_id long, class string, votes long")
    capped = L.cap_labels(votes, 10)
    assert {r["class"]: r["n"] for r in capped.groupBy("class").agg(F.count("*").alias("n")).collect()} == {"alpha": 10, "beta": 1}
    assert sorted(capped.collect()) == sorted(L.cap_labels(votes.orderBy(F.desc("row_id")), 10).collect())
    rows = spark.createDataFrame([(7, 200)], "user_id long, row_id long")
    known = spark.createDataFrame([(7, "alpha")], "user_id long, class string")
    tagged = L.manual_labels(votes, known, rows).where("row_id = 200").collect()
    assert [tuple(r) for r in tagged] == [(200, "alpha", 1)]


def test_threshold(spark):
    scores = spark.createDataFrame([(1, 0.55, 0.45), (2, 0.6, 0.4)], "user_id long, a double, b double")
    done = S.threshold_class(S.argmax_class(scores, {"a": "x", "b": "y"}), {"a": "x", "b": "y"}, 0.1)
    assert [r.predicted_class for r in done.orderBy("user_id").collect()] == ["undisclosed", "x"]


def test_same_name_on_two_days_counts_twice(spark):
    profiles = spark.createDataFrame([(1, "2024-01-01", "Ana"), (1, "2024-01-02", "Ana")], "user_id long, date string, name string")
    vocabulary = W.build_vocabulary(profiles, T.tokenize(F.col("name")))
    assert [tuple(r) for r in vocabulary.collect()] == [("ana", 2)]


def test_existing_days_are_kept_or_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *pairs: spark.createDataFrame(pairs, "x int, date string").withColumn("date", F.col("date").cast("date"))
    days.write_days(rows((1, "2024-01-01")), path)
    days.write_days(rows((2, "2024-01-01"), (3, "2024-01-02")), path)
    assert sorted(r.x for r in days.read_days(spark, path).collect()) == [1, 3]
    days.write_days(rows((4, "2024-01-02")), path, overwrite=True)
    assert sorted(r.x for r in days.read_days(spark, path, start="2024-01-01").collect()) == [1, 4]
    assert [r.x for r in days.read_days(spark, path, start="2024-01-02").collect()] == [4]


def test_numbering_is_dense_over_slices_and_skewed_groups(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(-1)).alias("g"))
    overall = R.number_rows(rows, [F.desc("id")]).collect()
    assert all(r.row_id == 4999 - r.id for r in overall)
    grouped = R.number_rows(rows, [F.asc("id")], "at", within=["g"]).collect()
    seen = {}
    for r in sorted(grouped, key=lambda r: r.id):
        assert r["at"] == seen.get(r.g, 0)
        seen[r.g] = r["at"] + 1


def test_outside_targets_follow_dataset_users(spark):
    edges = spark.createDataFrame([(10, 20, 1), (10, 99, 2), (20, 50, 3), (77, 10, 4)], "src long, dst long, weight long")
    rows = spark.createDataFrame([(10, 0), (20, 1)], "user_id long, row_id long")
    ids, matrix = W.adjacency(edges, rows)
    assert {r.id: r.node_id for r in ids.collect()} == {10: 0, 20: 1, 50: 2, 99: 3}
    assert sorted(tuple(r) for r in matrix.select("row_id", "node_id", "value").collect()) == [(0, 1, 1), (0, 3, 2), (1, 2, 3)]


def test_csv_keeps_odd_text(spark, tmp_path):
    text = 'a "quoted" \\ back, comma\nnew line'
    df = spark.createDataFrame([(1, text)], "id long, text string")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), df.schema).first().text == text


def test_term_list(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("santiago;CL\n\nlima\nlima;PE\n", encoding="utf-8")
    assert sorted(r.term for r in filters.term_list(spark, str(tmp_path / "terms.txt")).collect()) == ["lima", "santiago"]


def test_largest_strong_component(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long")
    found = {r.node: r.component for r in G.strong_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert sorted(r.node for r in G.largest_component(G.strong_components(edges)).collect()) == [1, 2, 3]


def test_null_groups_keep_their_rows(spark):
    from agorasift.operators.ranking import number_rows

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id int, cls string")
    got = {r["id"]: r["row_id"] for r in number_rows(df, [F.col("id")], within=["cls"]).collect()}
    assert got == {1: 0, 3: 1, 2: 0, 4: 1}


def test_broken_json_lines_are_not_written(spark, tmp_path):
    from agorasift.sources import days

    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text('{"id": 1}\n{"id": \n{"id": 2}\nnonsense\n')
    schema = spark.createDataFrame([], "id long").schema
    counts = days.json_to_parquet(spark, str(source), str(tmp_path / "out"), schema).collect()
    assert [tuple(r) for r in counts] == [("one.json", 2)]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_days_of_a_missing_and_a_broken_table(spark, tmp_path):
    from agorasift.sources import days

    assert days.known_days(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?s)."):
        days.known_days(spark, str(tmp_path / "bad"))


def test_quantile_over_slices(spark):
    from agorasift.operators.ranking import distinct_level_quantile

    values = [1, 1, 2, 5, 5, 5, 9, 14, None]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    known = sorted(v for v in values if v is not None)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        place = share * (len(known) - 1)
        low = int(place)
        want = known[low] + (place - low) * (known[min(low + 1, len(known) - 1)] - known[low])
        assert distinct_level_quantile(df, "x", share) == pytest.approx(want)
    assert distinct_level_quantile(df.where("x > 99"), "x", 0.5) is None


def test_hub_of_a_component_can_be_split(spark):
    """The step of the component search joins two plain exchanges, which adaptive execution splits."""
    from agorasift.operators.graph import _point_low

    pairs = spark.createDataFrame([(i, 0) for i in range(1, 2000)], "u long, v long")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        moved = _point_low(pairs)
        moved.collect()
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert "skew" in plan or plan.count("Exchange hashpartitioning(v") >= 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
