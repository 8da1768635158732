"""Chat formatting, line dedup and mixing: SQL on the small tables, odd rows, rules."""


import pytest

from agorasift.llm import chat, line_dedup, mixing
from agorasift.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F
from tests.compare import compare, connect
from tests.llm.brute import sha


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    ok, message = compare(spark, connect(small), name, QUERIES[name], ORACLES[name], small)
    assert ok, message


def test_chat_round_trip(spark):
    odd = ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<s>\\</s>", "[SYS] x [/SYS]", "[ROLE]a[TEXT]b[/TEXT]", "[[INST]", "<", " a ", "é\n\t", None]
    roles = ["system", "user", "assistant", "tool", "[ROLE]\n[TEXT]", None]
    rows = [(c, i, roles[(c + i) % len(roles)], odd[(3 * c + i) % len(odd)], 9) for c in range(12) for i in range(7)]
    rows += [(None, None, "user", "x", 9), (None, 1, "assistant", "y", 9), (None, 1, "assistant", "y", 9)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int"))
    read = got.select("conv_id", "n_turns", chat.read_chats(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("segments")).alias("loss"), "segments", "formatted").collect()
    assert len(read) == 13
    for r in read:
        given = sorted(((t or -1, ro or "", te or "") for c, t, ro, te, _ in rows if c == r["conv_id"]))
        want = [(ro, te) for _, ro, te in given]
        assert [tuple(t) for t in r["turns"]] == want and r["n_turns"] == len(want)
        assert r["loss"] == "".join(te for ro, te in want if ro == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_chat_orders(spark):
    orders = {"user": True, "user,assistant": True, "system,user,assistant,user": True, "system": False, "assistant": False,
              "user,user": False, "user,assistant,system": False, "tool": False, "user,assistant,tool,user": False}
    rows = [(name, i, role, "t") for name in orders for i, role in enumerate(name.split(","))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert {r["conv_id"]: r["valid_order"] for r in got.collect()} == orders


def kept_lines(docs):
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\f\r")
            if len(key) >= 10:
                held.setdefault(key, set()).add(line_dedup.NO_ID if doc is None else doc)
    out = []
    for doc, text in docs:
        lines, me = (text or "").split("\n"), line_dedup.NO_ID if doc is None else doc
        forms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\f\r") for x in lines]
        kept = [x for x, f in zip(lines, forms) if len(held.get(f, ())) < 2 or min(held[f]) == me]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_lines_odd_rows(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    extra = [(20, "Shared line number one\n\n  SHARED LINE NUMBER ONE \nmine alone"), (21, "shared line number one"), (22, "x\nshared line number one\t\nshort\nshort")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    df = odd_docs.select("doc_id", "text", "n_lines").unionByName(more.withColumn("n_lines", F.lit("x")))
    got = line_dedup.drop_shared_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["_n_lines"], r["n_dropped"], sha(r["text"] or "")) for r in got.collect()), key=repr) == kept_lines(docs + extra)
    assert got.where("doc_id = 3").first()["text"] is None
    assert line_dedup.drop_shared_lines(df.limit(0)).count() == 0


def test_lines_many_documents(spark):
    """Three documents as the threshold: two holders keep their lines."""
    rows = [(i, "a line that all hold\nonly %s of this" % ("two" if i < 2 else i)) for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()}
    assert got == {0: rows[0][1], 1: "only two of this", **{i: f"only {i} of this" for i in (2, 3, 4)}}


def test_mix_budgets(spark):
    rows = [(i, "w " * (i % 7 + 1), None if i % 10 == 0 else "abc"[i % 3] if i % 2 else "hot") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["taken"]
        s[3] += r["size"]
    assert list(by) and abs(sum(t for _, t, _, _ in by.values()) - total) < 1e-6
    for size, target, taken, sizes in by.values():
        assert size == sizes and target <= 3 * size and target - 1 < taken <= target


def test_mix_odd_rows(spark, odd_docs):
    got = mixing.mix(odd_docs)
    assert got.count() == odd_docs.count() and got.where("size = 0 AND taken > 0").count() == 0
    again = mixing.mix(odd_docs.repartition(7))
    key = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    assert key(got) == key(again)
    whole = mixing.mixture(odd_docs)
    assert whole.columns == [*odd_docs.columns, "_size", "source_size", "target", "taken"]
    assert whole.where("taken <= 0").count() == 0 and whole.count() > 0
    assert mixing.mixture(odd_docs.limit(0)).count() == 0
    assert mixing.mix(odd_docs.where("text IS NULL")).agg({"taken": "max"}).first()[0] == 0


def test_mix_does_not_depend_on_its_ranges(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "LEAST_DIGITS", 0)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert mixing.range_digits(200) == 2 and mixing.range_digits(10) == 0
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect())) == before


def test_native_plans_run_no_python(spark, small):
    for name in ("op1_chat_format", "op4_mix_sources", "op8_line_dedup"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
