"""Mixing of sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from agorasift.llm.storage import fresh, row_key, stored, tidy
from agorasift.operators.ranking import number_rows

WORD = r"[^\x20\x09-\x0D]+"
LEAST_DIGITS = 3  # leading hex digits of the hash key that make a range: 4096 ranges in each source, or more
RANGE_ROWS = 65_536  # rows of a range at most, were all rows of one source


def range_digits(rows: int) -> int:
    """Digits that keep a range at ``RANGE_ROWS`` rows or below; the result of a mix does not depend on them."""
    digits = LEAST_DIGITS
    while rows > RANGE_ROWS << 4 * digits and digits < 32:
        digits += 1
    return digits


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(
    sources: DataFrame, order: Sequence[Column], weights: Sequence[int], total: int, most_epochs: int
) -> DataFrame:
    """Share ``total`` among sources by weight, none above ``most_epochs`` times its size.

    ``sources`` has one row per source with ``source_size``; it gets ``weight``
    (the given list, repeating in the given order) and ``target``.  Sources
    above their bound are fixed there and the rest is shared again by weight
    until none is above; each turn is one aggregate over one row per source.
    """
    ranked = number_rows(sources, order, "at")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most_epochs)
    ranked = stored(ranked.drop("at"), "sources")
    rate, before = None, -1
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > F.col("bound")
        sums = ranked.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("bound")).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if sums["n"] == before or not sums["free"]:
            break
        before, rate = sums["n"], float(total - sums["fixed"]) / float(sums["free"])
    share = F.least(F.col("weight") * F.lit(rate or 0.0), F.col("bound").cast("double"))
    return ranked.withColumn("target", share).drop("bound")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """Words that a mixture takes from every document.

    Size of a document: its words.  Documents get hash-random keys and are
    sorted by them within ranges of each source; distributed prefix sums of
    the sizes (ranges first, then rows inside a range) place every document,
    and each source is cut at its exact budget: whole passes first, then the
    documents before the cut once more, the one at the cut in part.

    Returns one row per row of ``docs``: doc_id, size, source, source_size,
    target, taken and the row key (k1, k2).  Defined cases: null and empty
    texts have size 0 and take 0; a null source is a source of its own, last;
    a null id is hashed like a text of its own; rows are put in order by a hash
    of id and text, so rows without an id or with the same one are spread; rows equal in id and text follow each
    other and may differ in ``taken``, but their set of values is fixed; an
    empty table or one without words takes nothing.

    A source that holds a third of all rows is spread over its key ranges, so
    no window or join sees more than one range of one source together.  The
    number of ranges follows the number of rows (``range_digits``); a running
    sum over the ranges of a source sees one row per range.
    """
    first, second = row_key(F.col("doc_id"), F.col("text"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest, F.lit(str(seed))))
    name, none = F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")
    sized = docs.select("doc_id", "source", name, none, n_words(F.col("text")).alias("size"), first.alias("k1"),
                        second.alias("k2"), key.alias("key"))
    # equal rows are one, so many copies of a row are not sorted in one task
    sized = stored(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sized = sized.withColumn("range", F.substring("key", 1, range_digits(sized.agg(F.sum("copies")).first()[0] or 0)))
    ranges = sized.groupBy("name", "none", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    whole = Window.partitionBy("name", "none")
    before = F.sum("words").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = stored(ranges.select("name", "none", "range", F.coalesce(before, F.lit(0)).alias("before"),
                                  F.sum("words").over(whole).alias("source_size")), "ranges")
    sources = ranges.groupBy("name", "none").agg(F.max("source_size").alias("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = weighted_targets(sources, [F.col("none"), F.col("name")], weights, total, most_epochs).select(
        "name", "none", "target", F.floor("target").cast("long").alias("budget"))
    budgets = stored(ranges.join(targets, ["name", "none"]), "budgets")
    placed = sized.join(budgets, ["name", "none", "range"])
    inside = Window.partitionBy("name", "none", "range").orderBy("key", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - passes * F.col("source_size")
    placed = placed.withColumn("at", at).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("at")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "k1", "k2")


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that a mixture takes, with size, source_size, target and taken.

    Rows of which no word is taken go.  A size of zero has nothing to take and
    goes too.  Rows equal in id and text share what was taken of them: each
    gets the largest.  Clashing names get a leading underscore.
    """
    k1, k2, *names = fresh(docs, "k1", "k2", "size", "source_size", "target", "taken")
    with tidy(docs.sparkSession) as keep:
        taken = mix(docs, weights, most_epochs, seed).where("taken > 0").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(
            F.max(F.struct("taken", "size", "source_size", "target")).alias("got"))
        taken = keep(taken.select(k1, k2, *[F.col(f"got.{n.lstrip('_')}").alias(n) for n in names]), "taken")
    first, second = row_key(F.col("doc_id"), F.col("text"))
    return docs.withColumns({k1: first, k2: second}).join(taken, [k1, k2]).select(*docs.columns, *names)
