"""The source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

from agorasift.llm import divergence


def plain(rows, least_docs=30, top=50):
    """rows: (lang, source, text)"""
    total, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        total[lang, source].update(words)
        holders[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in holders[lang].items() if n >= least_docs)
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(total[lang, s]) for s in sources}
        q = shares(sum((total[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if total[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_more_sources_than_a_tile_and_more_terms_than_a_span(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "abcdefghijk" for b in "lmnopqrstu" for c in "vwxyzäöü" ]  # 880
    words += [w * 2 for w in words]
    rows = []
    for i in range(500):
        source = f"s{i % 37:02d}"
        text = " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 120)))
        rows.append(("xx" if i % 5 else "yy", source, text))
    rows += [("one", "only", "alone here"), ("none", "a", None), ("none", "b", "1 2 3")] + [("xx", "hot", " ".join(words))] * 40
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for least in (1, 3, 30):
        assert found(divergence.audit(docs, least_docs=least, top=7)) == plain(rows, least, 7)


def test_odd_rows(spark, odd_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    named = odd_docs.withColumnRenamed("k1", "place").withColumnRenamed("size", "value").withColumnRenamed("hits", "term")
    assert found(divergence.audit(named, least_docs=2)) == plain(rows, 2)
    assert found(divergence.audit(odd_docs)) == plain(rows)
    assert divergence.audit(odd_docs.limit(0)).count() == 0


def test_counts_beyond_a_long_product(spark):
    """Shares stay exact where a billion times the count exceeds 64 bits."""
    from pyspark.sql import functions as F

    n, whole, terms = 40_000_000_000, 90_000_000_007, 12_345
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(whole), F.lit(terms)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (whole + 5 * terms)
