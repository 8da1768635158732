"""Near copies of the pipeline: recall of planted copies, and nothing below 0.8."""

import random

import corpus_pipeline
from agorasift.llm import near_copies
from tests.llm import brute


def jaccard(a: str, b: str) -> float:
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_planted_copies_are_found(spark):
    rng = random.Random(5)
    rows, planted = [], []
    for base in range(0, 1200, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        copy = list(words)
        for at in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 35))):
            copy[at] = "X"
        rows += [(base, " ".join(words)), (base + 1, " ".join(copy))]
        planted.append(jaccard(rows[-2][1], rows[-1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert all(base in kept for base in range(0, 1200, 2))
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        of = [2 * i + 1 for i, j in enumerate(planted) if low <= j < high]
        assert len(of) > 20 and sum(d not in kept for d in of) >= 0.98 * len(of)
    below = [2 * i + 1 for i, j in enumerate(planted) if j < 0.8]
    assert len(below) > 20 and kept.issuperset(below)


def test_groups_against_all_pairs(spark):
    """A large group of copies of copies, in which many pairs are below 0.8, and odd rows."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        copy = list(words)
        for at in rng.sample(range(150), rng.randint(0, 6)):
            copy[at] = rng.choice("ABCDEFGH")
        texts.append(" ".join(copy))
    texts += [None, "", " \t", "one two", "ONE two", "one two three"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[7])]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                of = [of[j] if x == of[i] else x for x in of]
    want = {}
    for (doc, text), root in zip(rows, of, strict=True):
        want.setdefault(root, set()).add((doc, brute.sha(text or "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    k = {(r["k1"], r["k2"]): r["root"] for r in near_copies.similar_groups(docs).collect()}
    first, second = near_copies.row_key(docs.doc_id, docs.text)
    for r in docs.select("doc_id", "text", first.alias("k1"), second.alias("k2")).collect():
        got.setdefault(k[r["k1"], r["k2"]], set()).add((r["doc_id"], brute.sha(r["text"] or "")))
    assert sorted(map(sorted_key, got.values())) == sorted(map(sorted_key, want.values()))
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def sorted_key(group):
    return sorted((str(d), s) for d, s in group)
