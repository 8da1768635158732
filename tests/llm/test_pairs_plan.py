"""The join of the exploded segments is not broadcast, however small Spark takes it to be."""

from agorasift.llm import simhash


def test_segments_are_not_broadcast(spark, tmp_path):
    near = spark.createDataFrame([(0,), (3,), (15,), (31,), (1 << 40,)], "fp long")
    spark.range(3000).selectExpr("xxhash64(id) AS fp").union(near).write.parquet(str(tmp_path / "prints"))
    pairs = simhash.near_pairs(spark.read.parquet(str(tmp_path / "prints")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    found = sorted((r["a"], r["b"]) for r in pairs.collect())
    small = [0, 3, 15, 31, 1 << 40]
    assert found == [(a, b) for a in small for b in small if a < b and (a ^ b).bit_count() <= 4]
