"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agorasift.llm.arrow import map_texts
from agorasift.llm.components import connected
from agorasift.llm.storage import fresh, row_key, stored, tidy

SEED = 42
SHINGLES_AT_ONCE = 65_536
MOST_BITS = 4  # differing bits that the two 32-bit segments with balls of one bit can find
# lane k of entry b is bit k of byte b, so that sums of entries count bits
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: counted in bytes, 255 rows at a time."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes, size: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text, repeats included."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        pairs = zip(starts[at: at + SHINGLES_AT_ONCE].tolist(), ends[at: at + SHINGLES_AT_ONCE].tolist(), strict=True)
        counts += _bit_counts(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), size: int = 4) -> DataFrame:
    """The kept columns and ``fp``, in one pass over the texts and without a shuffle."""
    return map_texts(docs, "text", keep, T.StructType([T.StructField("fp", T.LongType())]),
                     lambda: lambda text: (fingerprint(text, size),))


def _balls(prints: DataFrame, fp: str, segment: str, value: str) -> DataFrame:
    """Every fingerprint under all values within one bit of each of its two segments."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    near = lambda n, half: F.transform(flips, lambda f: F.struct(F.lit(n).alias("s"), half.bitwiseXOR(f).alias("v")))
    both = prints.select("fp", F.explode(F.concat(near(0, high), near(1, low))).alias("at"))
    return both.select(F.col("fp").alias(fp), F.col("at.s").alias(segment), F.col("at.v").alias(value))


def near_pairs(prints: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at ``bits`` or fewer differing bits.

    Multi-index hashing: of four differing bits, a 32-bit segment has two at
    most.  Both sides are listed under the 33 values within one bit of each
    segment, so such a pair meets at a shared value, and the complete distance
    is verified there.  A pair is given once: at the smallest step between its
    high halves, or between its low halves where the high ones are too far.
    A fingerprint has a bounded number of links whatever the table's size;
    the join is a plain one that adaptive execution splits at a hot value.
    It is told to sort and merge: Spark takes a side to be as small as the
    fingerprints it is exploded from, 66 times too small, and would broadcast it.
    """
    if bits > MOST_BITS:
        raise ValueError(f"two segments with balls of one bit find {MOST_BITS} differing bits at most")
    left, right = _balls(prints, "a", "s1", "v1"), _balls(prints, "b", "s2", "v2")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    high = F.shiftrightunsigned(differ, 32)
    low = differ.bitwiseAND(F.lit(0xFFFFFFFF))
    met_high = (F.col("s1") == 0) & (F.col("v1") == _meeting(F.shiftrightunsigned("a", 32), high))
    met_low = (F.col("s1") == 1) & (F.bit_count(high) > 2) & (
        F.col("v1") == _meeting(F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)), low))
    verified = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= bits) & (met_high | met_low)
    return left.join(right.hint("merge"), (F.col("s1") == F.col("s2")) & (F.col("v1") == F.col("v2")) & verified).select("a", "b")


def _meeting(mine: Column, differ: Column) -> Column:
    """One value within a bit of both: mine, or mine with the lowest of two differing bits flipped."""
    lowest = differ.bitwiseAND(-differ)
    return F.when(F.bit_count(differ) <= 1, mine).otherwise(mine.bitwiseXOR(lowest))


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = MOST_BITS) -> DataFrame:
    """One row per document: doc_id, k1, k2 (row key), fp, root and component_id.

    Texts are linked when their fingerprints differ in ``bits`` bits or fewer;
    component_id is the smallest id reachable over links.  Equal fingerprints
    are one node, so copies are never paired.  ``root`` names the component by
    its smallest fingerprint.

    Defined cases: a null or empty text, or one of blanks, has fingerprint
    zero and is linked like any other; null ids are never a component_id
    unless the component has no other; repeated rows get a row each; an empty
    table gives an empty table; other columns are not read.
    """
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    prints = stored(fingerprints(keyed, ("doc_id", "k1", "k2"), size), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = stored(connected(near_pairs(nodes.select("fp"), bits)), "roots")
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    heads = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
    linked = stored(roots.join(heads, "root"), "linked")
    nodes = stored(nodes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")), "grouped")
    return prints.join(nodes, "fp").select("doc_id", "k1", "k2", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 4, bits: int = MOST_BITS) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id.

    Nulls sort last; equal ids are put in order by row key; of repeated rows
    one stays.  The columns are those of ``docs``.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    k1, k2 = fresh(docs, "k1", "k2")
    with tidy(docs.sparkSession) as keep:
        heads = near_duplicates(docs, size, bits).groupBy("root").agg(F.min(order).alias("head"))
        heads = keep(heads.select(F.col("head.k1").alias(k1), F.col("head.k2").alias(k2)).distinct(), "heads")
    first, second = row_key(F.col("doc_id"), F.col("text"))
    kept = docs.withColumns({k1: first, k2: second}).join(heads, [k1, k2], "left_semi")
    return kept.dropDuplicates([k1, k2]).select(*docs.columns)
