"""SimHash groups, decontamination, secrets and suffix dedup against plain Python."""

import random

import pytest

from agorasift.llm import decontaminate, secrets, simhash, suffix_dedup
from agorasift.llm.components import connected
from agorasift.llm.queries import QUERIES
from tests.llm import brute


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_simhash_query(spark, small, small_docs):
    got = rows(QUERIES["op2_simhash_dedup"](spark, small), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.groups(small_docs), key=repr)


def test_simhash_odd_rows(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = simhash.near_duplicates(odd_docs)
    assert sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got.collect()), key=repr) == \
        sorted(brute.groups(docs), key=repr)
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({g[2] for g in brute.groups(docs)})
    assert simhash.drop_near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_pairs_finds_every_distance(spark):
    rng = random.Random(5)
    made = {0, (1 << 63) - 1, -1, -(1 << 63)}
    for _ in range(60):
        base = rng.getrandbits(64)
        for bits in (1, 2, 3, 4, 5):
            moved = base
            for b in rng.sample(range(64), bits):
                moved ^= 1 << b
            made.add(moved - (1 << 64) if moved >> 63 else moved)
        made.add(base - (1 << 64) if base >> 63 else base)
    want = sorted((a, b) for a in made for b in made if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    got = simhash.near_pairs(spark.createDataFrame([(m,) for m in made], "fp long"))
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        simhash.near_pairs(got, 5)


def test_components_of_chain_hub_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(300)] + [(7, 7), (500, 501), (501, 502), (502, 500)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(301)} == {100}
    assert [got[n] for n in (500, 501, 502)] == [500] * 3
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_query(spark, small, small_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op3_decontaminate"](spark, small)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == \
        sorted(brute.contamination(small_docs, items), key=repr)
    assert got.where("contaminated").count() > 0


@pytest.mark.parametrize("per_block", [3, 100_000])
def test_decontamination_odd_rows(spark, odd_docs, per_block):
    items = [(1, "one two three four five six seven eight nine ten one two"), (2, None), (3, "!!"), (4, "Short"),
             (5, "ten one two"), (6, "é" * 300 + " token"), (1, "lorem IPSUM"), (None, "lorem ipsum"), (7, "absent words here")]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = decontaminate.find_windows(odd_docs, spark.createDataFrame(items, "item_id long, text string"), per_block=per_block)
    got = [(r["doc_id"], r["_n_words"], sum(b - a for a, b in zip(r["_hits"][::2], r["_hits"][1::2])), len(r["items"]),
            brute.sha(",".join(sorted(r["items"]))), bool(r["_hits"])) for r in found.collect()]
    want = brute.contamination(docs, [i for i in items if i[0] is not None])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd_docs, none).count() == len(docs)


def test_secret_query(spark, small, small_docs):
    got = QUERIES["op9_secret_scan"](spark, small)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == \
        sorted(((d, *brute.base_secrets(t)) for d, t in small_docs), key=repr)


def test_secret_rules():
    rng = random.Random(3)
    parts = ["password", "PassWD", "token", "api_key", "apikey", "secret", ":", "=", " ", '"', "'", "abc", "abcdef9", "AKIA",
             "AKIA" + "Q" * 16, "deadbeef" * 3, "é", "日本", "\n", "ſecret=abcdefgh", "toKen: ", "0" * 24, "x"]
    scanner = secrets.Scanner()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        spans = secrets._points(text.encode(), scanner.spans(text.encode()))
        told = [f"{secrets.KINDS[k].name}:{a}:{b}" for a, b, k in spans if k < 3]
        assert brute.sha(",".join(told)) == brute.base_secrets(text)[3], text


def test_checked_secrets():
    scanner = secrets.Scanner()
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    import zlib
    good = "ghp_" + body + secrets._base62(zlib.crc32(body.encode()), 6)
    names = lambda t: [secrets.KINDS[k].name for _, _, k in scanner.spans(t.encode())]
    assert names(f"x {good} y") == ["issued"] and names(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'}") == []
    assert names("card 4111111111111111.") == ["card"] and names("card 4111111111111112.") == []
    assert names("-----BEGIN RSA PRIVATE KEY-----") == ["key"]


def test_long_runs_are_read_once():
    scanner = secrets.Scanner()
    assert scanner.spans(b"eyJ" * 400_000) == []
    body = b"eyJ" + b"a" * 8 + b".eyJ" + b"b" * 8 + b"." + b"c" * 16
    assert [s[:2] for s in scanner.spans(b"x " + body)] == [(2, 2 + len(body))]


def test_suffix_query(spark, small, small_docs):
    got = QUERIES["op10_suffix_dedup"](spark, small)
    want = [(d, *r) for (d, _), r in zip(small_docs, brute.repeated_bytes([t for _, t in small_docs], 400), strict=True)]
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert got.agg({"n_removed": "sum"}).first()[0] > 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_random(spark, seed):
    """Passages of all lengths around the limit, overlapping, periodic, at both ends."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(n) for n in (35, 39, 40, 41, 45, 60, 200)] + ["ab" * 60, "z" * 90]
    texts = [None, "", make(39), passages[3], passages[3]]
    for _ in range(60):
        text = ""
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            text += rng.choice([make(rng.randint(0, 50)), p, p[a:b], p[: rng.randint(1, len(p))]])
        texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.drop_repeated(docs, length=40, gram=10)
    want = [(d, *r) for d, r in enumerate(brute.repeated_bytes(texts, 40))]
    assert [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in
            got.orderBy("doc_id").collect()] == want


def test_suffix_odd_rows(spark, odd_docs):
    docs = odd_docs.collect()
    want = [(r["doc_id"], *b) for r, b in zip(docs, brute.repeated_bytes([r["text"] for r in docs], 400), strict=True)]
    got = suffix_dedup.drop_repeated(odd_docs)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in got.collect()), key=repr) \
        == sorted(want, key=repr)
    assert suffix_dedup.drop_repeated(odd_docs.limit(0)).count() == 0


def test_long_text_in_parts(monkeypatch):
    """Windows found part by part are those found at once."""
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    first, last, key = suffix_dedup.runs_of_windows(text, 40, 10)
    each = {p: k for a, b, k in zip(first, last, key) for p in range(a, b + 1)}
    assert sorted(each) == list(range(4961))
    for at in range(0, 4961, 700):
        f, l, k = suffix_dedup.runs_of_windows(text[at: at + 700 + 39], 40, 10)
        assert all(each[p + at] == key for a, b, key in zip(f, l, k) for p in range(a, b + 1))
