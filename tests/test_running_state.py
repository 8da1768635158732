"""Streams that stop and start again: parts of running sums, state on disk."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agorasift.streaming import ingest as S
from agorasift.streaming.parts import RunningSums

SCHEMA = "k string, value long"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(number):
    return [("a", number), ("b", 1), ("a", 2), (None, 5)][: number % 4 + 1]


def totals(spark, sums):
    return {r.k: r.value for r in sums.totals(spark, SCHEMA).collect()}


def test_parts_merge_and_sum_up(spark, tmp_path):
    sums, want = RunningSums(str(tmp_path), ("k",), "value", fan=2), Counter()
    assert totals(spark, sums) == {}
    for number in range(9):
        sums.add(batch(spark, rows_of(number)), number)
        for k, v in rows_of(number):
            want[k] += v
        version = sums.latest(spark)
        assert len(version.parts) <= math.log2(number + 1) + 1
        covered = [b for p in version.parts for b in range(p.first_batch, p.last_batch + 1)]
        assert covered == list(range(number + 1)) and version.batch == number
    assert totals(spark, sums) == dict(want)
    stored = {p.name for p in (tmp_path / "parts").iterdir()}
    assert len(stored) <= 3 * 5 and {p.part for p in sums.latest(spark).parts} <= stored  # old parts go
    assert len(list((tmp_path / "versions").glob("version=*"))) == sums.kept_versions


def test_a_batch_counts_once_and_a_crash_shows_nothing(spark, tmp_path, monkeypatch):
    sums = RunningSums(str(tmp_path), ("k",), "value", fan=2)
    sums.add(batch(spark, [("a", 1)]), 0)
    sums.add(batch(spark, [("a", 1)]), 0)
    assert totals(spark, sums) == {"a": 1}
    with monkeypatch.context() as broken:
        broken.setattr(RunningSums, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sums.add(batch(spark, [("a", 10)]), 1)
    (tmp_path / "versions" / "version=1").mkdir()  # a list that was not finished
    assert totals(spark, sums) == {"a": 1}
    sums.add(batch(spark, [("a", 10)]), 1)
    assert totals(spark, sums) == {"a": 11}
    assert {p.name for p in (tmp_path / "parts").iterdir()} >= {p.part for p in sums.latest(spark).parts}


def test_an_empty_batch(spark, tmp_path):
    sums = RunningSums(str(tmp_path), ("k",), "value")
    sums.add(batch(spark, []), 0)
    sums.add(batch(spark, [("a", None)]), 1)
    assert totals(spark, sums) == {"a": None}


def test_bounds_of_settings():
    for wrong in ({"fan": 1}, {"kept_versions": 0}):
        with pytest.raises(ValueError):
            RunningSums("x", ("k",), "value", **wrong)


def write_edges(spark, path, first, last):
    edges = spark.range(first, last).select(
        F.lit("reply").alias("layer"), (F.col("id") % 3).alias("src"), F.lit(1).cast("long").alias("dst"), F.col("id").alias("weight"))
    edges.coalesce(1).write.mode("append").parquet(path)
    return edges.schema


def test_edge_stream_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    path, target, checkpoint = (str(tmp_path / n) for n in ("edges", "sums", "progress"))
    schema = write_edges(spark, path, 0, 10)
    start = lambda: S.running_edges(S.read_posts(spark, path, schema, 1), target, checkpoint, fan=2)
    start().awaitTermination()
    for first in (10, 20, 30):
        write_edges(spark, path, first, first + 10)
    with monkeypatch.context() as broken:
        clean = RunningSums.clean

        def stop_late(self, session):  # the version is there, the stream does not know
            clean(self, session)
            if self.latest(session).batch == 2:
                raise RuntimeError("lost")

        broken.setattr(RunningSums, "clean", stop_late)
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    start().awaitTermination()
    found = {r.src: r.weight for r in S.edge_totals(spark, target).collect()}
    assert found == {s: sum(i for i in range(40) if i % 3 == s) for s in range(3)}


def write_posts(spark, path, ids, hour):
    posts = spark.createDataFrame([(i,) for i in ids], "id long").withColumn(
        "created_at", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(hour), F.lit(0), F.lit(0)))
    posts.coalesce(1).write.mode("append").parquet(path)
    return posts.schema


def test_dedup_keeps_its_state_on_disk_over_restarts(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / n) for n in ("posts", "unique", "progress"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    schema = write_posts(spark, path, [1, 2, 2, 3], 1)

    def run():
        query = S.append_to(S.dedup(S.read_posts(spark, path, schema), "2 hours"), target, checkpoint)
        query.awaitTermination()
        states = [s for p in query.recentProgress for s in p["stateOperators"]]
        return sorted(r.id for r in spark.read.parquet(target).collect()), states

    found, states = run()
    assert found == [1, 2, 3]
    assert any(k.startswith("rocksdb") for s in states for k in s["customMetrics"])
    assert spark.conf.get(name) == before  # other queries keep theirs
    write_posts(spark, path, [3, 4, 1], 2)
    assert run()[0] == [1, 2, 3, 4]
    write_posts(spark, path, [9], 9)  # the watermark moves on
    write_posts(spark, path, [10], 9)
    found, states = run()
    assert found == [1, 2, 3, 4, 9, 10]
    assert states[-1]["numRowsTotal"] == 2  # ids 1 to 4 have left the state
