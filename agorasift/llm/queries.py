"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from agorasift.llm import (
    chat, decontaminate, divergence, language, line_dedup, mixing, prints, quality_gam, quality_rules, resampling, secrets, simhash,
    suffix_dedup, textstats,
)
from agorasift.llm.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def _sql_escaped(text: str) -> str:
    for c in chat.BRACKETS.controls():
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


CHAT_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, {_sql_escaped("replace(text, chr(92), chr(92) || chr(92))")} AS body,
    {_sql_escaped("replace(role, chr(92), chr(92) || chr(92))")} AS name,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM given
), marks AS (
  SELECT *, CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 19 + length(name) END
    + length(body) AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  length(string_agg(trained, '' ORDER BY pos)) AS loss_chars,
  sha256(string_agg(trained, '' ORDER BY pos)) AS loss_sha256,
  CAST(sum(chars) + count(*) - 1 AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, '>' ORDER BY pos), '(system>)?user(>assistant>user)*(>assistant)?') AS valid_order
FROM marks GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, root: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    given = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    added = spark.sql(
        f"SELECT * FROM VALUES (-1, 0, 'user', '{planted}'), (-1, 1, 'assistant', '{planted}') AS v(conv_id, turn, role, text)")
    added = added.select(*[F.col(f.name).cast(f.dataType) for f in given.schema])
    chats = chat.format_chats(given.unionByName(added))
    turns = F.transform(chat.read_chats(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = chat.loss_text(F.col("segments"))
    return chats.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid_order")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':42') AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), totals AS (
  SELECT *, sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS pos,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources
), rates AS (
  SELECT *, CAST(total - fixed AS DOUBLE) / CAST(free AS DOUBLE) AS rate FROM totals
), rate AS (
  SELECT coalesce(arg_min(rate, pos), 0.0) AS rate FROM rates WHERE weight * rate <= 3 * source_size
), targets AS (
  SELECT source, source_size, least(weight * rate.rate, CAST(3 * source_size AS DOUBLE)) AS target FROM sources, rate
), placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(passes * size + least(size, greatest(0, budget - passes * source_size - before)) AS BIGINT) AS taken
FROM cut
"""


@query("op4_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, root: str) -> DataFrame:
    """Words that a mixture of all sources takes from every document."""
    mixed = mixing.mix(table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


LINE_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS form
  FROM numbered
), shared AS (
  SELECT form, min(doc_id) AS keeper FROM keyed WHERE length(form) >= 10 GROUP BY form HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN shared s ON k.form = s.form
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op8_line_dedup", LINE_SQL)
def line_dedup_query(spark: SparkSession, root: str) -> DataFrame:
    """All documents without the lines that a document before them holds."""
    kept = line_dedup.drop_shared_lines(table(spark, root, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


@query("op2_simhash_dedup")
def simhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_duplicates(table(spark, root, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_BENCH_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
LEAK_SQL = f"""
WITH docs AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), items AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), found AS (SELECT p.doc_id, p.i, p.n, w.item FROM places p JOIN windows w ON w.n = p.n AND w.win = p.win),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (
  SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.told, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""


@query("op3_decontaminate", LEAK_SQL)
def decontaminate_query(spark: SparkSession, root: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, table(spark, root, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit("hits").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan(table(spark, root, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told("found").alias("spans"))


REPEAT_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(t[i:i + 399]) AS h FROM (SELECT doc_id, t, unnest(range(1, n - 398)) AS i FROM docs WHERE n >= 400)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM often)),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM starts),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS b FROM numbered GROUP BY doc_id, run),
totals AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a) + 1, 1) AS a, a - 1 AS b FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(r.b) + 1, 1), max(d.n) FROM docs d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT e.doc_id, unhex(coalesce(string_agg(hex(d.t[e.a:e.b]), '' ORDER BY e.a) FILTER (WHERE e.b >= e.a), '')) AS k
  FROM edges e JOIN docs d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
  sha256(k.k) AS kept_sha256
FROM docs d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN totals t ON t.doc_id = d.doc_id
"""


@query("op10_suffix_dedup", REPEAT_SQL)
def suffix_dedup_query(spark: SparkSession, root: str) -> DataFrame:
    """All documents without byte strings of 400 that stand elsewhere too."""
    cut = suffix_dedup.drop_repeated(table(spark, root, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_language_id")
def language_id(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document, from its text and the page that shows it."""
    docs = table(spark, root, "documents")
    evidence = language.page_evidence(table(spark, root, "pages"))
    found = language.identify(docs, evidence, language.train(docs))
    return found.select("doc_id", "lang", "probability", "accepted", "text_lang", "declared", "host")


@query("op6_quality_gam")
def quality_score(spark: SparkSession, root: str) -> DataFrame:
    """Quality score of every document by an additive model of its text."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, root, "labels"))
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", textstats.held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op7_quality_rules")
def quality_rules_query(spark: SparkSession, root: str) -> DataFrame:
    """Base counts of every document and the verdict of learned rules."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, root, "labels")))


_LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DRAW_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_BENCH_WORDS} AS w FROM documents),
items AS (SELECT {_BENCH_WORDS} AS w FROM benchmark),
doc_words AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM docs) GROUP BY ALL),
item_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM items) GROUP BY ALL),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_words UNION SELECT word FROM item_words)),
crcs AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) % 10000 AS bucket
  FROM words),
source AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM doc_words JOIN crcs USING (word) GROUP BY 1),
target AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM item_words JOIN crcs USING (word) GROUP BY 1),
gains AS (
  SELECT b AS bucket, CAST(floor(1000 * ln(
    ((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM source) + 10000))::DOUBLE
    / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000))::DOUBLE)) AS BIGINT) AS gain
  FROM range(10000) r(b) LEFT JOIN source ON source.bucket = b LEFT JOIN target ON target.bucket = b),
sums AS (SELECT row, CAST(sum(n * gain) AS BIGINT) AS total FROM doc_words JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY row),
weighed AS (
  SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE
    (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
    CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM docs LEFT JOIN sums ON sums.row = docs.row),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


@query("op11_importance_resampling", DRAW_SQL)
def importance_resampling(spark: SparkSession, root: str) -> DataFrame:
    """Weight and score of every document towards the benchmark, and the rank of those drawn."""
    drawn = resampling.resample(table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


AUDIT_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format(text="text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(n) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p
  FROM grid JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
over AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL BY NAME
  SELECT * FROM (SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM over) WHERE rank <= 50)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


@query("op12_source_divergence", AUDIT_SQL)
def source_divergence(spark: SparkSession, root: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that each source overuses."""
    return divergence.audit(table(spark, root, "documents").select("lang", "source", "text"))


_VOTES = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN k ELSE -k END) > 0 AS b{b}" for b in range(64))
_PRINT = " + ".join(f"CASE WHEN b{b} THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
PRINT_SQL = rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS row, doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT row, doc_id, text, coalesce(lead(text) OVER (ORDER BY row), first_value(text) OVER (ORDER BY row)) AS other,
    coalesce(lead(row) OVER (ORDER BY row), 1) AS next_row, length(text) // 3 AS cut FROM docs),
changed AS (SELECT *, substr(text, 1, length(text) - cut) || substr(other, 1, cut) AS edited FROM pairs),
texts AS (SELECT row, 0 AS kind, text AS t FROM changed UNION ALL SELECT row, 1, edited FROM changed),
words AS (
  SELECT row, kind, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
    SELECT row, kind, regexp_extract_all({_LOWER.format(text="t")}, '[^\x20\x09-\x0D]+') AS w FROM texts)),
hashed AS (SELECT row, kind, pos, md5_number_lower(word) AS h FROM words),
terms AS (
  SELECT row, kind, h FROM hashed UNION ALL
  SELECT row, kind, CAST((before::UHUGEINT * 1000003 + h) % 18446744073709551616::UHUGEINT AS UBIGINT) FROM (
    SELECT row, kind, h, lag(h) OVER (PARTITION BY row, kind ORDER BY pos) AS before FROM hashed) WHERE before IS NOT NULL),
weighed AS (SELECT row, kind, h, length(bin(count(*))) AS k FROM terms GROUP BY ALL),
votes AS (SELECT row, kind, {_VOTES} FROM weighed GROUP BY row, kind),
found AS (SELECT t.row, t.kind, coalesce({_PRINT}, 0) AS fp FROM texts t LEFT JOIN votes v ON v.row = t.row AND v.kind = t.kind),
joined AS (
  SELECT c.row, c.doc_id, length(c.text) AS n_chars, sha256(c.edited) AS edited_sha256, a.fp, b.fp AS edited_fp, n.fp AS next_fp
  FROM changed c JOIN found a ON a.row = c.row AND a.kind = 0 JOIN found b ON b.row = c.row AND b.kind = 1
  JOIN found n ON n.row = c.next_row AND n.kind = 0),
near AS (
  SELECT q.row, count(*) - 1 AS n_near FROM joined q JOIN joined o ON bit_count(xor(q.fp, o.fp)) <= 3 WHERE q.doc_id % 100 = 0 GROUP BY q.row)
SELECT doc_id, n_chars, edited_sha256, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, lower(lpad(to_hex(edited_fp), 16, '0')) AS edited_fingerprint,
  (64 - bit_count(xor(fp, edited_fp))) / 64.0::DOUBLE AS near_edited, (64 - bit_count(xor(fp, next_fp))) / 64.0::DOUBLE AS near_next, n_near
FROM joined LEFT JOIN near USING (row)
"""


@query("op13_document_fingerprints", PRINT_SQL)
def document_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint of every document and of its edited text; of every hundredth id, how many others are near."""
    found = stored(prints.fingerprint_edits(table(spark, root, "documents").select("doc_id", "text")), "prints")
    found = prints.count_near(found, F.col("doc_id") % 100 == 0)
    told = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", told("fp").alias("fingerprint"), told("edited_fp").alias("edited_fingerprint"),
        prints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        prints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
