"""Words are counted by pieces between spaces; cells and columns that nobody reads are not made."""

import pytest
from pyspark.sql import functions as F

from agorasift.functions import text as T
from agorasift.operators import daily, place
from agorasift.plans import ingest, labels
from agorasift.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "The cat, the CAT; the cat's don’t-know http://a.org/x?y=1 end", "a\nb\tc  the  \x0b the cat  the", None, "",
    " ", "@me_you@them the_end #tag! @_ !!! ... ❤️ 🙂🙂 x🙂", "http:// https://x http the-", "ΟΔΟΣ ΟΔΟΣ. İstanbul ŻÓŁĆ ñandú", "12 3.5 ¿qué? «là»",
]


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i % 4 if i % 5 else None, text) for i, text in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "user_id long, text string")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("by", [[], ["user_id"]])
def test_pieces_give_the_tokens_of_the_text(posts, by):
    plain = daily.token_frequency(posts, T.tokenize(F.col("text")), by)
    pieces = daily.token_frequency(posts, T.tokenize, by, "text")
    assert pieces.dtypes == plain.dtypes and plain.count() > 20
    assert rows(pieces) == rows(plain)
    if by:
        assert rows(daily.user_token_frequency(posts, T.tokenize, by, "text")) == rows(plain)


def test_listed_tokens_only(spark, posts):
    listed = spark.createDataFrame([("the",), ("cat",), ("the",), ("absent",), (None,)], "token string")
    plain = daily.token_frequency(posts, T.tokenize(F.col("text")), ["user_id"]).where(F.col("token").isin("the", "cat"))
    assert rows(daily.listed_frequency(posts, T.tokenize, listed, ["user_id"], "text")) == rows(plain) != []


LISTED = ["the", "cat", "cat's", "don’t-know", "end", "i\u0307stanbul", "istanbul", "οδος", "żółć", "12", "3", ".", "#tag", "@me_you@them",
          "@me_you", "🙂🙂", "x", "là", "ñandú", "absent", "http", "The"]


@pytest.mark.parametrize("most", [32, 2])
def test_listed_tokens_in_one_reading(spark, posts, monkeypatch, most):
    monkeypatch.setattr(daily, "MOST_TESTED", most)
    tables, pieces = [], daily.listed_pieces
    monkeypatch.setattr(daily, "listed_pieces", lambda *args: tables.append(1) or pieces(*args))
    listed = spark.createDataFrame([(w,) for w in [*LISTED, "the", "", None]], "token string")
    plain = daily.token_frequency(posts, T.tokenize(F.col("text")), ["user_id"]).where(F.col("token").isin(LISTED))
    got = daily.listed_frequency(posts, T.tokenize, listed, ["user_id"], "text")
    assert got.dtypes == plain.dtypes and rows(got) == rows(plain) != []
    assert bool(tables) == (most < len(LISTED))


@pytest.mark.parametrize("most", [100_000, 2])
def test_few_texts_are_tokenised_whole(spark, monkeypatch, most):
    monkeypatch.setattr(daily, "MOST_TOGETHER", most)
    texts = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)] + [(0, "the The"), (0, "cat"), (None, "end")],
                                  "doc_id long, text string")
    plain = daily.token_frequency(texts, T.tokenize(F.col("text")), ["doc_id"])
    got = daily.user_token_frequency(texts, T.tokenize, ["doc_id"], "text")
    assert got.dtypes == plain.dtypes and rows(got) == rows(plain) != []
    assert "_piece" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_listed(spark, posts):
    none = spark.createDataFrame([], "token string")
    assert daily.listed_frequency(posts, T.tokenize, none, ["user_id"], "text").count() == 0


def test_emotions_as_from_whole_texts(spark):
    lexicon = spark.createDataFrame([("the", "joy", 0.2), ("cat", "fear", 0.5), ("the", "anger", 0.1), ("@user", "sadness", 0.3),
                                     ("end", "other", 9.0)], "token string, label string, weight double")
    posts = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)] + [(0, "the")], "id long, text string")
    words = posts.select("id", F.explode(T.tokenize(T.mask_handles(F.col("text")))).alias("token")).join(lexicon, "token")
    found = {(r["id"], r["label"]): r["s"] for r in words.groupBy("id", "label").agg(F.sum("weight").alias("s")).collect()}
    import math

    got = place.emotion_scores(posts, lexicon).collect()
    assert len(got) == len(TEXTS) + 1 and len(found) > 6
    for r in got:
        parts = [math.exp(found.get((r["id"], e), 0.0)) for e in place.EMOTIONS]
        assert [r[e] for e in place.EMOTIONS] == pytest.approx([p / sum(parts) for p in parts])


@pytest.mark.parametrize("name", ["post_hashtags", "post_mentions", "post_urls"])
def test_texts_that_nobody_reads_are_not_read(spark, name):
    plan = getattr(ingest, name)(Tables(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Project [" in line and "doc_id" in line]
    assert reads and not any("text#" in line for line in reads)


def test_only_cells_of_rules_are_made(spark):
    t = Tables(spark, SMALL)
    rules = {(r["family"], r["token"]) for r in t.rules.collect()}
    listed = labels.rule_features(t)
    assert {(r["type"], r["token"]) for r in listed.collect()} <= rules
    everything = labels.user_features(t)
    wanted = t.rules.select(F.col("family").alias("type"), "token").distinct()
    assert rows(listed.select("row_id", "type", "token", "value")) == rows(
        everything.join(wanted, ["type", "token"], "left_semi").select("row_id", "type", "token", "value")) != []


def test_cells_that_add_up_exchange_no_texts(spark):
    t = Tables(spark, SMALL)
    parts = labels.user_features(t, add_up=True)
    cells = labels.user_features(t)
    summed = lambda df: rows(df.groupBy("row_id", "type", "token").agg(F.sum("value").alias("value")))
    assert summed(parts) == summed(cells) != []
    assert "RepartitionByExpression" not in parts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("by", [[], ["user_id"], ["user_id", "day"], ["tags"]])
def test_pieces_are_counted_in_the_tasks(spark, monkeypatch, by):
    from agorasift.operators import pieces

    monkeypatch.setattr(pieces, "HELD", 5)
    monkeypatch.setattr(pieces, "BYTES_AT_ONCE", 40)
    texts = spark.createDataFrame([(i % 3 or None, f"d{i % 2}", [i % 2], text) for i, text in enumerate(TEXTS * 4)],
                                  "user_id long, day string, tags array<int>, text string").repartition(2)
    plain = texts.select(*by, F.explode(F.split("text", " ")).alias("_piece")).groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    found = pieces.piece_counts(texts, by, "text")
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found.groupBy(*by, "_piece").agg(F.sum("_n").alias("_n"))) == rows(plain) != []


def test_cells_of_groups_are_counted_by_group(spark):
    t = Tables(spark, SMALL)
    kinds = [(u, ("alpha", "beta", None)[u % 3]) for u in range(1, 40) if u % 5] + [(3, "beta")]
    classes = spark.createDataFrame(kinds, "row_id long, predicted_class string")
    got = labels.user_features(t, groups=classes)
    users = labels.user_features(t).join(classes, "row_id").select(F.col("predicted_class").alias("row_id"), "type", "token", "value")
    summed = lambda df: rows(df.groupBy("row_id", "type", "token").agg(F.sum("value").alias("value")))
    assert summed(got) == summed(users) != []
    everyone = labels.user_features(t, groups=F.lit("all"))
    assert rows(everyone.select("type", "token").distinct()) == rows(labels.user_features(t).select("type", "token").distinct())
    # texts are joined to nothing once they are cut
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    cut = [i for i, line in enumerate(plan) if "MapInArrow" in line]
    above = {min((i for i in range(c) if depth(plan[i]) == d), key=lambda i: c - i) for c in cut for d in {depth(p) for p in plan[:c]} if d < depth(plan[c])}
    assert len(cut) == 3 and not any("Join" in plan[i] for i in above)


@pytest.mark.parametrize("special", [[], [("żółć", "joy", 0.3), ("i̇stanbul", "fear", 0.7), ("οδος", "anger", 0.2)]])
def test_emotions_in_one_reading(spark, monkeypatch, special):
    monkeypatch.setattr(place, "listed_pieces", lambda *args: pytest.fail("texts are read twice"))
    lexicon = spark.createDataFrame([("the", "joy", 0.2), ("cat's", "fear", 0.5), ("@user", "sadness", 0.3), ("http", "anger", 0.4),
                                     ("12", "joy", 0.1), ("", "joy", 9.0), (None, "joy", 9.0), *special], "token string, label string, weight double")
    texts = [*TEXTS, "THE @x http httpd http12 (the) the\nthe", "@", "the " * 50]
    posts = spark.createDataFrame(list(enumerate(texts)) + [(None, "the")], "id long, text string")
    words = posts.select("id", F.explode(T.tokenize(T.mask_handles(F.col("text")))).alias("token")).join(lexicon, "token")
    found = {(r["id"], r["label"]): r["s"] for r in words.groupBy("id", "label").agg(F.sum("weight").alias("s")).collect()}
    import math

    got = place.emotion_scores(posts, lexicon).collect()
    assert len(got) == len(texts) + 1 and len(found) > 8
    for r in got:
        parts = [math.exp(found.get((r["id"], e), 0.0) if r["id"] is not None else 0.0) for e in place.EMOTIONS]
        assert [r[e] for e in place.EMOTIONS] == pytest.approx([p / sum(parts) for p in parts])
