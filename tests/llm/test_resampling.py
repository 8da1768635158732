"""Importance resampling against plain Python."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from agorasift.llm import resampling
from tests.llm.brute import bench_words


def plain(docs, items, most_words=1, buckets=10_000, percent=10, least_words=20):
    def runs(text):
        words = bench_words(text)
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                for n in range(1, most_words + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text))
    for text in items:
        t.update(runs(text))
    of_s, of_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets))))
    scored = []
    for doc, text in docs:
        found = runs(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(bench_words(text))))
    enough = sorted((r for r in scored if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [*range(1, percent * len(enough) // 100 + 1)]
    drawn = Counter((*r[:4], rank) for r, rank in zip(enough, ranks))
    drawn.update((*r[:4], None) for r in enough[len(ranks):])
    drawn.update((*r[:4], None) for r in scored if r[4] < least_words)
    return drawn


def found(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_runs_have_the_crc_of_their_text():
    texts = [b"One two, three-four FIVE five", "naïve Straße 東京 x".encode(), b"", b"  ", b"a", b"ab" * 70_000 + b" end of it", b"a a a a"]
    got = list(resampling.run_buckets(texts, 4, 1 << 30))
    for text, (words, runs) in zip(texts, got, strict=True):
        want = bench_words(text.decode())
        assert words == len(want)
        assert runs.tolist() == [zlib.crc32(" ".join(want[i:i + n]).encode()) % (1 << 30) for n in range(1, 5) for i in range(len(want) - n + 1)]


@pytest.mark.parametrize("settings", [{}, {"most_words": 3, "buckets": 70_000, "percent": 50, "least_words": 5}])
def test_all_rows_against_plain(spark, small, small_docs, settings):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = resampling.resample(docs, items, **settings)
    assert found(got) == plain(small_docs, [r["text"] for r in items.collect()], **settings)


def test_odd_rows(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = spark.createDataFrame([("one two lorem",), (None,), ("",)], "text string")
    for settings in ({"percent": 60}, {"percent": 100, "least_words": 0}):
        assert found(resampling.resample(odd_docs, target, **settings)) == plain(docs, ["one two lorem", None, ""], **settings)
    kept = resampling.draw(odd_docs, target, percent=60)
    assert kept.columns == odd_docs.columns and kept.count() >= 1
    assert found(resampling.resample(odd_docs, target.limit(0))) == plain(docs, [])
    assert resampling.resample(odd_docs.limit(0), target).count() == 0


def test_draws_what_is_like_the_target(spark):
    rows = [(i, ("alpha beta gamma " if i % 10 == 0 else "one two three ") * 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("gamma beta alpha " * 50,)], "text string")
    drawn = {r["doc_id"] for r in resampling.draw(docs, target, percent=10).collect()}
    assert len(drawn) == 40 and sum(d % 10 == 0 for d in drawn) >= 38


def test_shift_equals_zero_bytes():
    lengths = np.array([0, 1, 2, 7, 300, 65_537])
    crcs = np.array([zlib.crc32(b"word")] * len(lengths), np.uint32)
    for crc, n in zip(resampling.shifted(crcs, lengths).tolist(), lengths.tolist(), strict=True):
        assert crc ^ zlib.crc32(bytes(n)) == zlib.crc32(b"word" + bytes(n))
    assert re.fullmatch("[0-9a-z ]+", resampling._FOLDED[:128].decode())
