"""Texts are joined and exchanged last, and rows stay as the shared SQL gives them."""

import datetime

import pytest
from pyspark.sql import functions as F

from agorasift.functions import text as T
from agorasift.operators import annotate, daily
from agorasift.plans import ingest, views as V
from agorasift.plans.registry import Tables
from agorasift.sources import posts as P


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with rows that come twice, null values and ids that nothing refers to."""
    root = str(tmp_path_factory.mktemp("odd"))
    at = datetime.datetime(2024, 1, 3, 12)
    kinds = ("click", "view", "error", "purchase", None)
    events = [(i, at + datetime.timedelta(hours=7 * i), i % 4, kinds[i % 5], '{"k": %d}' % (i % 3)) for i in range(60)]
    events += events[5:9] + [(None, at, 1, "click", None), (61, None, None, "view", '{"k": 1}')]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    write(events, "event_id long, ts timestamp, user_id long, event_type string, props string", "events")
    docs = [(i, f"text {i}" if i % 3 else None, "en" if i % 2 else None) for i in range(9) if i != 4]
    write(docs + docs[:2] + [(2, "other", "fr"), (None, "lost", "de")], "doc_id long, text string, lang string", "documents")
    pages = [(i, f"http://h{i}.org") for i in range(6) if i != 2] + [(1, "http://again.org"), (None, "x")]
    write(pages, "page_id long, url string", "pages")
    write([(i, f"Customer#{i}", i % 2, 1.5 * i) for i in (0, 1, 1, 2)], "c_custkey long, c_name string, c_nationkey long, c_acctbal double", "customer")
    write([(0, "NATION_0"), (1, None)], "n_nationkey long, n_name string", "nation")
    return Tables(spark, root)


def _shared(t, name):
    """A view by the SQL that both engines share."""
    view = V.VIEWS[name]
    return t.spark.sql(view.text, **{n: _shared(t, n) if n in V.VIEWS else getattr(t, n) for n in view.inputs})


@pytest.mark.parametrize("name", ["posts", "located", "profiles", "linked"])
def test_texts_come_last(odd, name):
    got, want = getattr(odd, name), _shared(odd, name)
    assert got.dtypes == want.dtypes and want.count() > 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation [" in line]
    assert "doc_id" in reads[-1] and sum("text" in line.split("Join")[0] for line in reads) >= 1
    assert all("Project [page_id" not in line for line in plan.splitlines()[plan.splitlines().index(reads[-1]):])


def test_reference_texts_are_kept(odd):
    linked = odd.linked
    assert linked.where("ref_id IS NOT NULL").count() > 0 and linked.where("ref_id IS NULL").count() > 0


def test_counts_of_a_user_are_not_exchanged(spark, monkeypatch):
    rows = [(u, f"w{i % 5} w{i % 7} the") for u, n in ((1, 40), (2, 3), (None, 6), (3, 0)) for i in range(n)] + [(2, None)]
    posts = spark.createDataFrame(rows, "user_id long, text string")
    tokens = T.tokenize(F.col("text"))
    want = sorted(map(repr, daily.token_frequency(posts, tokens, ["user_id"]).collect()))
    together = daily.user_token_frequency(posts, tokens)
    assert sorted(map(repr, together.collect())) == want
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and ", token" not in plan.split("hashpartitioning(user_id")[1].split(")")[0]
    for most in (5, 10, 50):  # the prolific user, and the null user too
        monkeypatch.setattr(daily, "MOST_TOGETHER", most)
        assert sorted(map(repr, daily.user_token_frequency(posts, tokens).collect())) == want
    assert daily.user_token_frequency(posts.limit(0), tokens).count() == 0


def test_lists_of_posts_that_share_ids(spark):
    rows = [(1, i % 7, f"t{i}" if i % 4 else None) for i in range(20)] + [(None, 1, "n"), (2, None, "a"), (2, None, "b")]
    posts = spark.createDataFrame(rows, "user_id long, id long, text string")
    got = {(r["user_id"], r["part"]): r["texts"] for r in daily.posts_list_per_user(posts, chunk=6).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")  # noqa: E731  nulls first
    for user in (1, 2, None):
        texts = [r[2] for r in sorted((r for r in rows if r[0] == user), key=order)]
        for part in range(0, len(texts), 6):
            assert got.pop((user, part // 6)) == texts[part: part + 6]
    assert not got


def test_lists_of_posts_number_no_texts(spark, monkeypatch):
    seen = []
    number = daily.number_rows
    monkeypatch.setattr(daily, "number_rows", lambda df, *a, **k: seen.append(df.columns) or number(df, *a, **k))
    daily.posts_list_per_user(spark.createDataFrame([(1, 1, "a")], "user_id long, id long, text string"))
    assert seen == [["user_id", "id"]]


def test_oldest_posts_are_chosen_by_their_keys(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [(1, day(5), 1, "late"), (1, day(4), 1, "early"), (2, day(3), 1, "b"), (3, day(6), 1, "c"), (4, day(2), 9, "other"), (None, day(9), 1, "n")]
    posts = spark.createDataFrame(rows, "id long, date date, user_id long, text string")
    users = spark.createDataFrame([(1,)], "user_id long")
    got = [tuple(r) for r in annotate.posts_of_users(posts, users, max_posts=2).collect()]
    assert got == [(2, day(3), 1, "b"), (1, day(4), 1, "early")]
    everything = {r["id"]: r["text"] for r in annotate.posts_of_users(posts, users).collect()}
    assert everything == {1: "early", 2: "b", 3: "c", None: "n"}


def test_quoted_texts_do_not_meet_the_own_ones(odd):
    full, lean = odd.linked, odd.linked_without_quoted
    assert lean.dtypes == full.dtypes
    want = full.withColumn("ref_text", F.when(F.col("rt_id") > 0, F.col("ref_text")))
    assert sorted(map(repr, lean.collect())) == sorted(map(repr, want.collect()))
    assert lean.where("quote_id > 0 AND ref_id IS NOT NULL").count() > 0 and lean.where("ref_text IS NOT NULL").count() > 0
    read = lambda **what: sorted(map(repr, ingest.raw_posts(odd, **what).select("id", P.post_text()).collect()))
    assert read(quoted_texts=False) == read()
    plan = ingest.post_text(odd)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("CASE WHEN (rt_id" in line and "AS ref_text" in line for line in plan[last:])
