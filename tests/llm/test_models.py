"""Language identification, quality score and rules: planted signals, held-out accuracy, plain counts."""

import random

import numpy as np
import pytest

import corpus_pipeline
from agorasift.llm import decontaminate, language, quality_gam, quality_rules, simhash, textstats
from agorasift.llm.queries import QUERIES
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_native import kept_lines

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{MIDDLE}/labels.parquet")


def test_counts_against_plain_python(small_docs):
    rng = random.Random(2)
    parts = ["a", "b", "ab", " ", "\n", "#", "é", "\t", "A", "日", "x y z w v ", "\x0b", "1"]
    texts = [t for _, t in small_docs] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text in texts:
        assert tuple(textstats.counts_of(text.encode())[:5]) == brute.text_counts(text), text


def test_ratios_alike_in_spark_and_numpy(spark, small):
    counted = textstats.text_counts(spark.read.parquet(f"{small}/documents.parquet"), ["doc_id"])
    rows = counted.select(*textstats.COUNTS, *[e.alias(f"r_{n}") for n, e in textstats.ratios().items()]).collect()
    matrix = textstats.ratio_matrix(np.array([r[: len(textstats.COUNTS)] for r in rows]))
    assert np.allclose(matrix, np.array([r[len(textstats.COUNTS):] for r in rows], float))


def test_rules_query(spark, labels):
    got = QUERIES["op7_quality_rules"](spark, MIDDLE)
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.text_counts(docs[r["doc_id"]])
        assert tuple(r[n] for n in textstats.COUNTS[:5]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    judged = got.join(labels, "doc_id").where(textstats.held_out() & ~F.col("base_failed")).collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert right >= 0.95 * len(judged)


def test_rules_find_a_planted_conjunction():
    rng = np.random.default_rng(4)
    values = {n: rng.random(3000) for n in "abc"}
    bad = (values["a"] > 0.7) & (values["b"] <= 0.4)
    rules = quality_rules.learn(values, bad)
    dropped = np.zeros(3000, bool)
    for rule in rules:
        dropped |= rule.covers(values)
    assert (dropped == bad).mean() > 0.98 and {c.name for r in rules for c in r.conditions} >= {"a", "b"}
    assert quality_rules.learn(values, np.zeros(3000)) == []
    assert quality_rules.learn({n: np.zeros(0) for n in "ab"}, np.zeros(0)) == []


def test_score_query(spark, labels):
    got = QUERIES["op6_quality_gam"](spark, MIDDLE).cache()
    assert got.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    judged = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in judged)


def test_scores_ignore_held_out_labels(spark, labels):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    flipped = labels.withColumn("quality", F.when(textstats.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_gam.train(docs, labels), quality_gam.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 2) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9
    constant = quality_gam.fit(np.zeros((0, 3)), np.zeros(0))
    assert np.allclose(constant.score(np.ones((2, 3))), 0.5)


def test_models_odd_rows(spark, odd_docs, labels):
    model = quality_gam.fit(np.random.default_rng(0).random((50, 14)), np.arange(50) % 2)
    scored = quality_gam.score(odd_docs.withColumn("score", F.lit(1)), model)
    assert scored.columns[-1] == "_score" and scored.where("_score BETWEEN 0 AND 1").count() == odd_docs.count()
    rules = quality_rules.judge(odd_docs, quality_rules.train(odd_docs, labels.limit(0)))
    assert rules.count() == odd_docs.count() and rules.where("kept AND base_failed").count() == 0
    assert quality_rules.judge(odd_docs.limit(0), []).count() == 0 and quality_gam.score(odd_docs.limit(0), model).count() == 0


def test_language_query(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", F.col("lang").alias("given"))
    got = QUERIES["op5_language_id"](spark, MIDDLE).join(docs, "doc_id")
    rows = got.collect()
    assert len(rows) == docs.count()
    assert sum(r["lang"] == r["given"] for r in rows) >= 0.98 * len(rows)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)
    assert any(r["declared"] for r in rows) and any(r["host"].endswith(".net") for r in rows)


def test_language_evidence_decides_where_the_text_does_not(spark):
    """A text that both languages share goes with markup, or with its host."""
    rows = [(i, "the house of the river" if i % 2 else "das haus am fluss", "en" if i % 2 else "de", "s") for i in range(200)]
    rows += [(300, "xq", None, "s"), (301, "xq", None, "s"), (302, "12 34", None, "s"), (303, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = [(i, f"http://a.example.{'com' if i % 2 else 'de'}/x/{i}", "<html>") for i in range(200)]
    pages += [(300, "https://a.example.com/x/300?p=1", "<!DOCTYPE html><HTML dir=ltr LANG='de-AT'>"), (301, "http://a.example.de/301.html", "<html>"),
              (400, "not an address", None), (401, None, None)]
    evidence = language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    model = language.train(docs)
    assert model.languages == ("de", "en")
    got = {r["doc_id"]: r for r in language.identify(docs, evidence, model).collect()}
    assert got[301]["lang"] == "de" and got[301]["host"] == "a.example.de"
    assert got[300]["declared"] == "de" and got[302]["lang"] == "und" and not got[303]["accepted"]
    assert all(got[i]["lang"] == ("en" if i % 2 else "de") for i in range(200))
    kept = language.drop_unidentified(docs, evidence, model)
    assert kept.columns == docs.columns and kept.count() == 202
    empty = docs.limit(0)
    assert language.identify(docs, evidence, language.train(empty)).where("accepted").count() == 0
    assert language.identify(empty, evidence, model).count() == 0


def test_pipeline_stages_against_plain_python(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, small).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        old, new = before.collect(), after.collect()
        texts = {r["doc_id"]: r["text"] for r in new}
        if name != "mixing":
            assert after.columns == columns
        if name == "language_id":
            assert {r["doc_id"] for r in old} - set(texts) == {r["doc_id"] for r in old if not any(c.isalpha() for c in r["text"])}
        elif name == "line_dedup":
            want = kept_lines([(r["doc_id"], r["text"]) for r in old])
            assert sorted((d, brute.sha(t)) for d, t in texts.items()) == sorted((w[0], w[3]) for w in want)
        elif name == "simhash_dedup":
            of = brute.groups([(r["doc_id"], r["text"]) for r in old])
            assert set(texts) == {g[2] for g in of}
        elif name == "decontamination":
            found = brute.contamination([(r["doc_id"], r["text"]) for r in old], items)
            assert set(texts) == {f[0] for f in found if not f[5]} and len(texts) < len(old)
        else:
            assert all(0 < r["taken"] <= 3 * r["size"] for r in new) and len(new) > len(old) / 3
        before = after
    assert corpus_pipeline.run(spark, small).count() == len(new)


def test_helpers_agree():
    assert decontaminate.merged([(5, 7), (1, 3), (2, 5)]) == [1, 7]
    assert simhash.fingerprint(b"") == 0
