"""How the words of a source differ from those of other sources of its language, in exact numbers.

Counts of a group (a language and source) are held as bitmaps: for each
count that occurs, the set of terms with that count, in words of 64 terms.
Two sources meet set by set: AND and popcount give the number of terms with
each pair of counts, and what is left of a set met a count of zero.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from agorasift.llm.storage import stored
from agorasift.operators.ranking import number_rows

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
ADDED = 5  # to each count
WORD = 64  # terms in a word of a bitmap
SPAN = 16  # words that one group of a task holds
TILE = 16  # sources of a side in one group of a task
HELD = 200_000  # counts that a task holds before it sends them on

# letters only: A-Z lower-cased, and all bytes of characters beyond ASCII
_FOLDED = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()
_GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term.

    Tasks add up their own texts first; nulls count as empty.
    """
    def sent(counts: dict[tuple[str, str], Counter], holders: dict[tuple[str, str], Counter]) -> pa.RecordBatch:
        rows = [(*group, term.decode("utf-8", "replace"), n, holders[group][term]) for group, of in counts.items() for term, n in of.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(*[batch.column(i) for i in range(2)], batch.column(2).cast(pa.binary()), strict=True):
                group, words = (lang.as_py(), source.as_py()), text.as_py().translate(_FOLDED).split()
                before = len(counts[group])
                counts[group].update(words)
                holders[group].update(set(words))
                held += len(counts[group]) - before
                if held >= HELD:
                    yield sent(counts, holders)
                    counts, holders, held = defaultdict(Counter), defaultdict(Counter), 0
        yield sent(counts, holders)

    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    counted = read.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, whole: Column, terms: Column) -> Column:
    """One more than the floored billionths of a smoothed count; exact whatever the counts."""
    upper = (n + ADDED).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    lower = F.greatest(whole + ADDED * terms, F.lit(1)).cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", upper, lower)).cast("long")


def _per_source(values: np.ndarray, starts: np.ndarray, axis: int) -> np.ndarray:
    """Sums of the rows (or columns) of each source; those of a source stand together."""
    return np.add.reduceat(values, starts, axis=axis) if len(starts) else values.take([], axis=axis)


def _tile_distances(rows: pa.Table) -> pa.Table:
    """Sums of |p - q| of two tiles of sources over one span of terms, both ways round.

    Rows are (lang, one, other, place, word, p, bits, width), one per bitmap.  Word -1
    has a source's p for a count of zero.  At most TILE sources a side and SPAN words.
    """
    rows = rows.sort_by([("place", "ascending")])
    of = {c: rows.column(c).to_numpy() for c in ("one", "other", "place", "word", "p", "width")}
    bits = rows.column("bits").to_numpy().view(np.uint64)
    one, other = int(of["one"][0]), int(of["other"][0])
    sides = [of["place"] // TILE == tile for tile in (one, other)]
    zero = of["word"] < 0
    places = [of["place"][zero & s] for s in sides]
    base = [of["p"][zero & s] for s in sides]
    none = np.abs(base[0][:, None] - base[1][None, :])
    total = none * int(of["width"][0])
    for word in np.unique(of["word"][~zero]):
        here = [np.flatnonzero((of["word"] == word) & s) for s in sides]
        found = [np.unique(np.searchsorted(places[k], of["place"][here[k]]), return_index=True) for k in range(2)]
        (own_a, from_a), (own_b, from_b) = found
        p, q = of["p"][here[0]][:, None], of["p"][here[1]][None, :]
        left, right = bits[here[0]][:, None], bits[here[1]][None, :]
        size_a, size_b = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
        joint = np.bitwise_count(left & right).astype(np.int64)
        total[np.ix_(own_a, own_b)] += _per_source(_per_source(joint * np.abs(p - q), from_a, 0), from_b, 1)
        # what a set shares with no set of the other source meets a count of zero there
        met_a, met_b = np.zeros((len(joint), len(places[1])), np.int64), np.zeros((len(places[0]), joint.shape[1]), np.int64)
        met_a[:, own_b], met_b[own_a] = _per_source(joint, from_b, 1), _per_source(joint, from_a, 0)
        total[own_a] += _per_source((size_a - met_a) * np.abs(p - base[1][None, :]), from_a, 0)
        total[:, own_b] += _per_source((size_b - met_b) * np.abs(base[0][:, None] - q), from_b, 1)
        # terms that occur in either source are not zero in both
        used = np.zeros_like(total)
        used[own_a] += _per_source(size_a - met_a, from_a, 0)
        used[:, own_b] += _per_source(size_b, from_b, 1)
        total -= none * used
    a, b = np.nonzero(places[0][:, None] != places[1][None, :])
    mine, theirs, value = places[0][a], places[1][b], total[a, b]
    if one != other:
        mine, theirs, value = np.concatenate((mine, theirs)), np.concatenate((theirs, mine)), np.concatenate((value, value))
    lang = pa.array([rows.column("lang")[0].as_py()] * len(mine), pa.string())
    return pa.table({"lang": lang, "place": pa.array(mine, pa.int64()), "with": pa.array(theirs, pa.int64()), "value": pa.array(value, pa.int64())})


def bitmaps(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, n, word, bits): the terms of each group with each count, 64 to a word.

    ``terms`` numbers the kept terms of a language (lang, term, id).
    """
    placed = counts.join(terms.select("lang", "term", "id"), ["lang", "term"])
    bit = F.expr("shiftleft(1L, CAST(pmod(id, 64) AS INT))")
    return placed.groupBy(*_GROUP, "n", F.floor(F.col("id") / WORD).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def pair_distances(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each two sources of a language.

    ``groups`` has lang, source, place (number of the source within its
    language), whole (occurrences) and terms (of the language).  Sources meet
    in tiles and terms in spans, so no task holds more than two tiles of one
    span, whatever the number of sources or terms.
    """
    tiles = F.floor(F.col("place") / TILE).cast("long")
    most = groups.groupBy("lang").agg(F.max(tiles).alias("last"))
    groups = stored(groups.join(most, "lang").withColumn("tile", tiles), "divergence-groups")
    of = groups.select(*_GROUP, "place", "whole", "terms", "tile", "last")
    spans = F.greatest(F.floor((F.col("terms") - 1) / (SPAN * WORD)), F.lit(0)).cast("long")
    zeros = of.withColumns({"span": F.explode(F.sequence(F.lit(0).cast("long"), spans)), "n": F.lit(0).cast("long"),
                            "word": F.lit(-1).cast("long"), "bits": F.lit(0).cast("long")})
    filled = sets.join(of, _GROUP).withColumn("span", F.floor(F.col("word") / SPAN).cast("long"))
    rows = filled.unionByName(zeros).withColumns({
        "p": _share(F.col("n"), F.col("whole"), F.col("terms")),
        "width": F.greatest(F.least(F.lit(SPAN * WORD), F.col("terms") - F.col("span") * SPAN * WORD), F.lit(0)).cast("long")})
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumns(
        {"one": F.least("tile", "with"), "other": F.greatest("tile", "with")})
    kept = rows.select("lang", "span", "one", "other", "place", "word", "p", "bits", "width")

    found = kept.groupBy("lang", "span", "one", "other").applyInArrow(_tile_distances, "lang string, place long, with long, value long")
    found = found.groupBy("lang", "place", "with").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "place", "source")
    return found.join(names, ["lang", "place"]).join(
        names.select("lang", F.col("place").alias("with"), F.col("source").alias("item")), ["lang", "with"]).select(*_GROUP, "item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to other sources, and the terms a source overuses.

    A language keeps the terms that ``least_docs`` of its documents hold.  Each
    kept term has a smoothed share of every group, in billionths.  Part
    ``pair`` sums the differences of two sources of a language over all kept
    terms; part ``term`` gives the ``top`` occurring terms whose share is above
    that of the whole language.  Ranks start at 1, larger values first, then
    items by their bytes.

    Defined cases: null text, lang and source are empty; a group without terms
    has counts of zero; a language that keeps no term has pairs of value 0; a
    language with one source has no pairs; repeated rows count each; an empty
    table gives an empty table; other columns are not read.

    Texts are read in one pass and counted where they are.  Only counts are
    exchanged, so a source with a third of all rows is as small as any other.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    empty = F.lit("")
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in _GROUP]).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # frequent terms first: the words of the bitmaps then hold terms of like counts
    terms = stored(number_rows(terms, [F.desc("n"), F.col("term")], "id", within=["lang"]), "divergence-terms")
    kept = stored(counts.join(terms.select("lang", "term"), ["lang", "term"]).select(*_GROUP, "term", "n"), "divergence-kept")
    whole = kept.groupBy(*_GROUP).agg(F.sum("n").alias("whole"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_whole"))
    groups = number_rows(occurring, [F.col("source")], "place", within=["lang"]).join(whole, _GROUP, "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["whole", "terms", "lang_whole"]), "divergence-sources")
    pairs = pair_distances(bitmaps(kept, terms), groups.drop("lang_whole"))
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": place})
    own = kept.join(terms.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"]).join(groups, _GROUP)
    p = _share(F.col("n"), F.col("whole"), F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_whole"), F.col("terms"))
    over = own.select(*_GROUP, F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    best = over.withColumns({"part": F.lit("term"), "rank": place}).where(F.col("rank") <= top)
    columns = [*_GROUP, "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(best.select(*columns))
