"""Benchmark items without an id hit, and are not named."""

from agorasift.llm import decontaminate


def test_items_without_id_hit(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "none of it"), (3, "two three five six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (7, "three four")], "item_id long, text string")
    got = {r["doc_id"]: (r["hits"], r["items"]) for r in decontaminate.find_windows(docs, items).collect()}
    assert got == {1: ([1, 4], ["7"]), 2: ([], []), 3: ([0, 2], [])}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]
