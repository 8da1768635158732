"""Document fingerprints and their search against plain Python."""

import random
import re
from collections import Counter
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from agorasift.llm import prints


def fingerprint(text, most_words=2):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    own = [int.from_bytes(md5(w.encode()).digest()[8:], "little") for w in words]
    terms = Counter()
    for n in range(1, most_words + 1):
        for i in range(len(own) - n + 1):
            h = 0
            for x in own[i:i + n]:
                h = (h * 1_000_003 + x) % 2**64
            terms[h] += 1
    votes = [sum(n.bit_length() * (1 if h >> b & 1 else -1) for h, n in terms.items()) for b in range(64)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def plain(rows, most_words=2):
    """rows in the order of the operator"""
    out = []
    for (doc, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, other = text or "", other or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + other[:cut]
        out.append((doc, len(text), sha256(changed.encode()).hexdigest(), *[fingerprint(t, most_words) for t in (text, changed, other)]))
    return Counter(out)


def found(df):
    unsigned = lambda v: v & (1 << 64) - 1
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], *map(unsigned, (r["fp"], r["edited_fp"], r["next_fp"]))) for r in df.collect())


@pytest.mark.parametrize("most_words", [1, 2, 4])
def test_all_rows_against_plain(spark, small, small_docs, most_words):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    rows = sorted(small_docs, key=lambda r: -r[0])
    assert found(prints.fingerprint_edits(docs, most_words)) == plain(rows, most_words)


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.orderBy(
        F.desc_nulls_last("doc_id"), F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id")).collect()]
    assert found(prints.fingerprint_edits(odd_docs)) == plain(rows)
    one = odd_docs.where("doc_id = 7")
    assert found(prints.fingerprint_edits(one)) == plain([r for r in rows if r[0] == 7])
    assert prints.fingerprint_edits(odd_docs.limit(0)).count() == 0


def test_an_id_that_most_rows_share_is_spread(spark):
    rows = [(None if i % 2 else 5, "same text of all rows " * 3) for i in range(4000)] + [(9, "another"), (1, "last one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = prints.fingerprint_edits(docs)
    assert got.count() == len(rows)
    assert got.where("doc_id IS NULL AND fp = next_fp").count() == 1999  # the last of all is followed by the first, 9


def test_search_finds_every_pair_once(spark):
    rng = random.Random(8)
    made = {0, 2**63 - 1, -1, -2**63}
    for _ in range(120):
        base = rng.getrandbits(64)
        for bits in (0, 1, 2, 3, 4):
            moved = base
            for b in rng.sample(range(64), bits):
                moved ^= 1 << b
            made.add(moved - (1 << 64) if moved >> 63 else moved)
    made = sorted(made)
    queries = made[::7]
    table = spark.createDataFrame([(m,) for m in [*made, *made[:20], None]], "fp long")
    asked = spark.createDataFrame([(q,) for q in [*queries, None, queries[0]]], "fp long")
    for radius, blocks in ((0, 1), (1, 4), (3, 6), (3, 4)):
        distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
        want = sorted((q, m, distance(q, m)) for q in queries for m in made if distance(q, m) <= radius)
        assert sorted(map(tuple, prints.near_fingerprints(asked, table, radius, blocks).collect())) == want
    with pytest.raises(ValueError):
        prints.near_fingerprints(asked, table, 4, 4)
    assert prints.near_fingerprints(asked, table.limit(0)).count() == 0


def test_rows_near_a_query_are_counted_with_their_copies(spark):
    rows = [(100, 0), (1, 0), (2, 0b111), (3, 0b1111), (200, 1 << 40), (None, 7)]
    got = prints.count_near(spark.createDataFrame(rows, "doc_id long, fp long"), F.col("doc_id") % 100 == 0)
    assert {r["doc_id"]: r["n_near"] for r in got.collect()} == {100: 4, 1: None, 2: None, 3: None, 200: 2 + 0, None: None}


def test_edits_stay_nearer_than_other_documents(spark, small):
    got = prints.fingerprint_edits(spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 400"))
    near = got.select(prints.likeness(F.col("fp"), F.col("edited_fp")).alias("e"), prints.likeness(F.col("fp"), F.col("next_fp")).alias("n"))
    row = near.agg(F.avg("e").alias("e"), F.avg("n").alias("n"), F.avg((F.col("e") > F.col("n")).cast("int")).alias("won")).first()
    assert row["e"] > 0.7 and row["n"] < 0.6 and row["won"] > 0.97
