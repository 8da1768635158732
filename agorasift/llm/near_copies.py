"""Groups of documents with similar word shingles: MinHash candidates, exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agorasift.llm.arrow import map_texts
from agorasift.llm.components import connected
from agorasift.llm.storage import discard, fresh, row_key, stored, stored_at, tidy

SEED = 42
SIZE = 5  # words of a shingle
LEAST = (4, 5)  # similarity that links, as a fraction
BANDS, BAND_ROWS = 24, 6  # a pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^24 = 0.9993
SKETCH = BANDS * BAND_ROWS // 16  # numbers of 16 times four bits
# of 144 minima, 18.75 % differ in four bits at a similarity of 0.8: 27, with a standard deviation of 4.7; this is three above
MOST_DIFFERENT = 41
TURNS = 3  # in which bands are compared with one of their members
SHINGLES_AT_ONCE = 512
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; all words of a shorter one."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)),
                                 np.uint64, len(starts)))


def described(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """One signed key per band, from the smallest of the shingles under each of its orders; four bits of each of these, packed."""
    if not len(hashes):
        return [], [0] * SKETCH
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        least = np.minimum(least, (hashes[at: at + SHINGLES_AT_ONCE, None] * _ODD).min(0))
    rows = least.reshape(BANDS, BAND_ROWS)
    bits = (least & np.uint64(15)).astype(np.uint8)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)], \
        (bits[::2] | bits[1::2] << 4).view(np.int64).tolist()


def _described(text: bytes) -> tuple:
    found = shingles(text)
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63), len(found), *described(found)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The groups (u, v) of pairs whose shingles have a similarity of ``LEAST`` or more, by counting them all."""
    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    enough = LEAST[1] * common >= LEAST[0] * (F.size("x") + F.size("y") - common)
    return pairs.join(one, "a").join(two, "b").where(enough).select("u", "v").distinct()


def _can_be_similar(n: Column, m: Column) -> Column:
    return LEAST[1] * F.least(n, m) >= LEAST[0] * F.greatest(n, m)


def _differing() -> Column:
    """Places at which the sketches s and t differ."""
    total = F.lit(0)
    for i in range(SKETCH):
        x = F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _candidates(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    """(set, shingles) of the sets in ``heads`` (k1, k2, set), read again from one text of each."""
    one = keyed.join(heads, ["k1", "k2"]).dropDuplicates(["set"])
    return map_texts(one, "text", ["set"], T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))]),
                     lambda: lambda text: (shingles(text).view(np.int64).tolist(),))


def _roots(sets: DataFrame, keyed: DataFrame) -> DataFrame:
    """(set, root) of the sets that are linked to another.

    Sets that share a band are candidates.  In turns, one member of each band
    is compared with those that are not linked to it yet, so a large group of
    copies needs few comparisons of each member.  Links join whole groups, so
    each turn goes on with groups, and fewer of them.  When a turn links
    nothing, or after ``TURNS``, all members of a band that are still in
    different groups meet; the join itself leaves out those whose sketches
    differ in more than ``MOST_DIFFERENT`` places, so of the copies of one text that are
    not similar to each other few pairs are compared in full.
    """
    keys = sets.select("set", "n", "k1", "k2", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band")
    keys = stored(keys.join(shared, "band"), "bands")
    sketches = sets.select("set", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)])
    sets = stored(_candidates(keyed, stored(keys.select("k1", "k2", "set").distinct(), "candidate-heads")), "candidates")
    found, path = stored_at(keys.select("set", "n", "band", F.col("set").alias("root")), "open-bands")
    roots, turn = None, 0
    while True:
        last = turn == TURNS
        if last:
            found = stored(found.join(sketches, "set"), "sketched-bands")
            other = found.select("band", F.col("set").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"),
                                 *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)])
            met = found.join(other, "band").where((F.col("set") < F.col("b")) & (_differing() <= MOST_DIFFERENT))
        else:
            centre = F.min_by(F.struct("set", "n", "root"), F.struct(F.xxhash64("set", F.lit(turn)), "set"))
            centres = found.groupBy("band").agg(centre.alias("c")).select(
                "band", F.col("c.set").alias("b"), F.col("c.n").alias("m"), F.col("c.root").alias("other"))
            met = found.join(centres, "band")
        met = met.where((F.col("root") != F.col("other")) & _can_be_similar(F.col("n"), F.col("m")))
        pairs = met.select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b"),
                           F.least("root", "other").alias("u"), F.greatest("root", "other").alias("v")).distinct()
        links = stored(_similar(pairs, sets), "links")
        if links.isEmpty():
            if last:
                return roots if roots is not None else links.select(F.col("u").alias("set"), F.col("v").alias("root"))
            turn = TURNS
            continue
        merged = connected(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).select("node", F.col("root").alias("to"))
        if roots is None:
            roots = stored(merged.select(F.col("node").alias("set"), F.col("to").alias("root")), "copy-roots")
        else:
            moved = roots.join(merged, F.col("root") == F.col("node"), "left").select("set", F.coalesce("to", "root").alias("root"))
            alone = merged.join(roots.select("set"), F.col("node") == F.col("set"), "left_anti").select(F.col("node").alias("set"), F.col("to").alias("root"))
            roots = stored(moved.unionByName(alone), "copy-roots")
        if last:
            return roots
        now = found.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        several = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        old = path
        found, path = stored_at(now.join(several.select("band"), "band"), "open-bands")
        discard(found.sparkSession, old)
        turn += 1


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, k1, k2 (row key) and ``root``, the group of near copies.

    Documents are linked when the sets of their five-word shingles have a
    Jaccard similarity of 0.8 or more; a group is what links reach.  Every link
    is verified on complete sets.  Candidates share one of ``BANDS`` MinHash
    bands, which a pair at 0.8 misses in 0.07 % of cases.  Equal sets are one
    node, so exact copies are never paired.

    Defined cases: null and empty texts, or those of blanks, are copies of each
    other only; texts of fewer than five words have one shingle of all words;
    repeated rows are judged alike; an empty table gives an empty table.
    """
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    added = T.StructType([T.StructField("set", T.LongType()), T.StructField("n", T.LongType()),
                          T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])
    read = stored(map_texts(keyed, "text", ["doc_id", "k1", "k2"], added, lambda: _described), "bands-of-texts")
    # shingles are not kept: they are larger than the texts, and few texts are candidates
    one = read.groupBy("set").agg(F.min_by(F.struct("n", "bands", "sketch", "k1", "k2"), F.struct("k1", "k2")).alias("one"))
    roots = _roots(stored(one.select("set", "one.*"), "sets"), keyed)
    return read.select("doc_id", "k1", "k2", "set").join(roots, "set", "left").select(
        "doc_id", "k1", "k2", F.coalesce("root", "set").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Nulls sort last; equal ids are put in order by row key; of repeated rows
    one stays.  The columns are those of ``docs``.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    k1, k2 = fresh(docs, "k1", "k2")
    with tidy(docs.sparkSession) as keep:
        heads = similar_groups(docs).groupBy("root").agg(F.min(order).alias("head"))
        heads = keep(heads.select(F.col("head.k1").alias(k1), F.col("head.k2").alias(k2)).distinct(), "heads")
    first, second = row_key(F.col("doc_id"), F.col("text"))
    kept = docs.withColumns({k1: first, k2: second}).join(heads, [k1, k2], "left_semi")
    return kept.dropDuplicates([k1, k2]).select(*docs.columns)
