"""Language identification: rare languages are known, unlisted ones and noise are rejected."""

import random

from pyspark.sql import functions as F

from agorasift.llm import language
from agorasift.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"
FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
}


def test_small_table_knows_every_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.col("lang").alias("given"))
    rows = QUERIES["op5_language_id"](spark, small).join(docs, "doc_id").collect()
    assert {r["given"] for r in rows if r["lang"] == r["given"]} == {"de", "en", "es", "fr"}
    assert sum(r["lang"] == r["given"] for r in rows if r["given"] == "es") == 17


def test_rare_language_and_unlisted_texts(spark):
    """Three labelled texts of a language in a table whose sample is far smaller than it; foreign texts and noise."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = [r[0] for r in docs.where("lang = 'es' AND length(text) > 1000").orderBy("doc_id").limit(3).collect()]
    docs = docs.withColumn("lang", F.when((F.col("lang") != "es") | F.col("doc_id").isin(rare), F.col("lang")))
    model = language.train(docs, most=100)
    assert model.languages == ("de", "en", "es", "fr")
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(80)) for _ in range(5)]
    added = [(-1 - i, t, None, "s") for i, t in enumerate([*FOREIGN.values(), *noise])]
    evidence = language.page_evidence(spark.createDataFrame([], "page_id long, url string, html string"))
    both = docs.unionByName(spark.createDataFrame(added, docs.schema))
    given = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", F.col("lang").alias("given"))
    rows = language.identify(both, evidence, model).join(given, "doc_id", "left").collect()
    assert not any(r["accepted"] for r in rows if r["doc_id"] < 0) and sum(r["doc_id"] < 0 for r in rows) == len(added)
    clean = [r for r in rows if r["doc_id"] >= 0]
    assert sum(r["lang"] == r["given"] for r in clean) >= 0.99 * len(clean)
    spanish = [r for r in clean if r["given"] == "es"]
    assert sum(r["lang"] == "es" for r in spanish) >= 0.95 * len(spanish)
