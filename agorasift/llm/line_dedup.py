"""Removal of lines that several documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agorasift.llm.storage import ascii_lower, fresh, row_key, stored, tidy

BLANKS = " \t\n\x0b\f\r"
NO_ID = 2**63 - 1  # stands for a null id: after every other document


def drop_shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines whose normalised form is in ``min_docs`` documents or more.

    Lines are exploded and normalised (blanks stripped at both ends, A-Z
    lower-cased), forms of ``min_chars`` code points or more are hashed to 128
    bits, and distinct documents are counted per hash.  A form over the
    threshold keeps its lines in the document with the smallest id alone.
    Texts are cut and joined again by line position.

    Returns ``docs`` with the text replaced and two more columns, ``n_lines``
    (before dropping) and ``n_dropped``; clashing names get a leading
    underscore.  Defined cases: a null or empty text is one empty line, and a
    null text stays null; all rows with a null id count as one document, after
    all others; rows equal in id and text are treated alike and all stay; an
    empty table gives an empty table.

    The first aggregate is by (hash, document), so a line that a third of all
    documents hold is spread; the second combines inside each task.  Only ids,
    positions and hashes are shuffled for the search, texts once at the end.
    """
    k1, k2, dropped, n_lines, n_dropped = fresh(docs, "k1", "k2", "dropped", "n_lines", "n_dropped")
    first, second = row_key(F.col("doc_id"), F.col("text"))
    lines = docs.where(F.length("text") >= min_chars).select(
        first.alias("k1"), second.alias("k2"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.posexplode(_lines(ascii_lower(F.col("text")))).alias("at", "line"))
    form = F.trim("line", F.lit(BLANKS))
    lines = lines.withColumn("form", form).where(F.length("form") >= min_chars).select(
        "k1", "k2", "doc", "at", F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(1), "form").alias("h2"))
    with tidy(docs.sparkSession) as keep:
        lines = stored(lines, "lines")
        per_doc = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        shared = per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.min("doc").alias("keeper"))
        shared = stored(shared.where(F.col("n") >= min_docs).drop("n"), "shared-lines")
        drops = lines.join(shared, ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
        drops = keep(drops.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("at").alias(dropped)), "dropped-lines")
    keyed = docs.withColumns({k1: first, k2: second}).join(drops, [k1, k2], "left")
    parts = _lines(F.coalesce("text", F.lit("")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped), lambda i: F.get(parts, i))
    return keyed.select(*[
        F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(c)
        if c == "text" else F.col(c) for c in docs.columns
    ], F.size(parts).cast("long").alias(n_lines),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(n_dropped))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)
