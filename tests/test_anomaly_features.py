"""The feature table of users holds the components of all layers."""

import datetime
from types import SimpleNamespace

from agorasift.plans import analysis

DAY = datetime.date(2024, 1, 5)


def test_components_are_features(spark):
    users = list(range(1, 25))
    posts = [(u, u, DAY, 0, 0, 0, 0, 0, 0) for u in users]
    profiles = [(u, DAY, f"user{u}", "text", 3, 4, 5, datetime.date(2020, 1, 1)) for u in users]
    edges = [(DAY, "retweet", u, u + 1, 2) for u in range(1, 12)]  # twelve nodes
    edges += [(DAY, "retweet", 20, 21, 2), (DAY, "quote", 1, 2, 2)]  # too small
    edges += [(DAY, "reply", 13, u, 1) for u in range(14, 25)]  # too light
    edges += [(DAY, "quote", 5, u, 3) for u in range(12, 22)]
    tables = SimpleNamespace(
        posts=spark.createDataFrame(posts, "id long, user_id long, date date, rt_id long, rt_user_id long, quote_id long, "
                                           "quote_user_id long, reply_id long, reply_user_id long"),
        profiles=spark.createDataFrame(profiles, "user_id long, date date, screen_name string, description string, "
                                                 "followers_count long, friends_count long, statuses_count long, created_at date"),
        edges=spark.createDataFrame(edges, "date date, layer string, src long, dst long, weight long"),
        users=spark.createDataFrame([(u, 1) for u in users], "user_id long, dataset_posts long"),
        predictions=spark.createDataFrame([(u, "alpha") for u in users], "user_id long, predicted_class string"),
        ages=spark.createDataFrame([(u, "old") for u in users], "user_id long, predicted_class string"))
    rows = {r["user_id"]: r for r in analysis.features(tables).collect()}
    assert set(rows) == set(users)
    for u in users:
        assert rows[u]["retweet_component"] == (1 if u <= 12 else None)
        assert rows[u]["quote_component"] == (5 if u == 5 or 12 <= u <= 21 else None)
        assert rows[u]["reply_component"] is None
