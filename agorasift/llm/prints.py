"""Fingerprints of documents by weighted votes of their terms, and a search for near ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import md5, sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from agorasift.llm.storage import stored

BITS = 64
MOST_WORDS = 2  # of a term
FACTOR = 1_000_003  # a run's hash is a polynomial in it over the hashes of its words
TERMS_AT_ONCE = 65_536
WORDS_HELD = 200_000  # hashes of words that a task remembers
RADIUS, BLOCKS = 3, 6  # tables of three blocks of six: 20, with keys of about 32 bits

_WRITTEN = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("doc_id", "k1", "k2", "n_chars")], T.StructField("edited_sha256", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("edited_fp", T.LongType()), T.StructField("next_fp", T.LongType()),
    T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())])


class WordHashes(dict[bytes, int]):
    """The last 64 bits of the MD5 of each word asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        found = self[word] = int.from_bytes(md5(word, usedforsecurity=False).digest()[8:], "little")
        return found


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits.

    A bit becomes a byte, and eight bytes are added at once as one number,
    for as many rows as a byte can count.
    """
    if not len(hashes):
        return np.zeros(BITS, np.int64)
    spread = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)


class Fingerprinter:
    """SimHash of whole texts.

    Terms are runs of one to ``most_words`` words (of anything but ASCII
    blanks, A-Z lower-cased).  A word is hashed by the last 64 bits of its MD5,
    a run by a polynomial over its words' hashes.  A term found n times votes
    with the number of binary digits of n, for or against each bit; a bit is
    set if more vote for it.  No terms give zero.
    """

    def __init__(self, most_words: int = MOST_WORDS):
        self.most_words = most_words
        self.hashes = WordHashes()

    def __call__(self, text: str) -> int:
        words = text.encode("utf-8", "replace").lower().split()  # on bytes: A-Z only, and ASCII blanks only
        own = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        terms, run = [own], own
        for size in range(2, self.most_words + 1):
            run = run[: max(0, len(own) - size + 1)] * np.uint64(FACTOR) + own[size - 1:]
            terms.append(run)
        hashes, times = np.unique(np.concatenate(terms), return_counts=True)
        digits = np.frexp(times)[1]
        votes = np.zeros(BITS, np.int64)
        for weight in np.unique(digits).tolist():
            of = hashes[digits == weight]
            for at in range(0, len(of), TERMS_AT_ONCE):
                part = of[at: at + TERMS_AT_ONCE]
                votes += weight * (2 * set_bits(part) - len(part))
        return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by as much of the start of the other."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (BITS - F.bit_count(a.bitwiseXOR(b))) / float(BITS)


def _judged(prints: Fingerprinter, text: str, other: str) -> tuple[str, int]:
    changed = edited(text, other)
    return sha256(changed.encode("utf-8", "replace")).hexdigest(), prints(changed)


def _neighbours(most_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over the sorted rows of a slice: each row with the next one.

    The first text of a slice goes on as its ``head`` and the last row as its
    ``open`` row with its text, so that slices can be joined afterwards.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, part, last = Fingerprinter(most_words), TaskContext.get().partitionId(), None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch.column(i) for i in range(4)], strict=True):
                doc, k1, k2, text = (v.as_py() for v in row)
                text = text or ""
                fp = prints(text)
                if last is None:
                    out.append((doc, k1, k2, len(text), None, fp, None, None, part, "head", text))
                else:
                    digest, changed = _judged(prints, last[3], text)
                    out.append((*last[:3], len(last[3]), digest, last[4], changed, fp, part, None, None))
                last = (doc, k1, k2, text, fp)
            yield _batch(out)
        if last is not None:
            yield _batch([(*last[:3], len(last[3]), None, last[4], None, None, part, "open", last[3])])

    return work


_ARROW = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], names=_WRITTEN.names)


def _closed(most_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last rows of slices, with the text that comes next."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(most_words)
        for batch in batches:
            rows = zip(*[batch.column(i) for i in range(7)], strict=True)
            for doc, k1, k2, fp, text, next_fp, other in ([v.as_py() for v in row] for row in rows):
                digest, changed = _judged(prints, text, other)
                yield _batch([(doc, k1, k2, len(text), digest, fp, changed, next_fp, 0, None, None)])

    return work


def fingerprint_edits(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: doc_id, k1, k2, n_chars, edited_sha256, fp, edited_fp, next_fp.

    Documents stand in descending order of their ids; after the last comes the
    first.  A document's edited text has its last third (rounded down, in code
    points) replaced by as many from the start of the next document, or by all
    of it.  ``fp`` is the whole text's fingerprint, ``edited_fp`` that of the
    edited text, ``next_fp`` that of the next document.

    Defined cases: null and empty texts have fingerprint zero; null ids come
    last; equal ids are put in order by a hash of their texts; rows equal in
    id and text follow each other in any order; a single row is its own next;
    an empty table gives an empty table; other columns are not read.

    Texts are exchanged once, by ranges of ids; each task sees one text and the
    next, and only the texts at both ends of a slice are kept for the joint.
    Repeated rows are spread by their place in the input, so no id is too large for
    a task.
    """
    text = F.col("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("k1"),
                        F.xxhash64(text, F.lit(1), "doc_id").alias("k2"), text)
    order = [F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")]
    placed = keyed.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, F.asc("_tie")).sortWithinPartitions(*order, F.asc("_tie"))
    read = stored(placed.select("doc_id", "k1", "k2", "text").mapInArrow(_neighbours(most_words), _WRITTEN), "print-rows")
    heads = read.where(F.col("edge") == "head").select("part", F.col("text").alias("other"), F.col("fp").alias("head_fp"))
    parts = heads.select("part")  # one row per slice
    after = F.lead("part").over(Window.orderBy("part"))
    first = F.min("part").over(Window.partitionBy(F.lit(0)))
    steps = parts.select("part", F.coalesce(after, first).alias("after"))
    ends = read.where(F.col("edge") == "open").join(steps, "part").join(
        heads.withColumnRenamed("part", "after"), "after").select("doc_id", "k1", "k2", "fp", "text", F.col("head_fp").alias("next_fp"), "other")
    ends = ends.mapInArrow(_closed(most_words), _WRITTEN)
    columns = ["doc_id", "k1", "k2", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]
    return read.where(F.col("edge").isNull()).select(*columns).unionByName(ends.select(*columns))


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(first bit, mask) of each block; the first ones are a bit longer where 64 does not divide."""
    sizes = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    return [(sum(sizes[:i]), (1 << size) - 1) for i, size in enumerate(sizes)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tables(prints: DataFrame, fp: str, radius: int, blocks: int) -> DataFrame:
    """Every fingerprint under its key in each of the permuted tables: some blocks in front, all others free."""
    cut = _blocks(blocks)
    masks = [_signed(sum(cut[b][1] << cut[b][0] for b in front)) for front in combinations(range(blocks), blocks - radius)]
    each = F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key")
    return prints.select(fp, each)


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) for all fingerprints of ``prints`` within ``radius`` bits of one of ``queries``.

    Both have a column ``fp``; repeated and null values count once and not at all.  Fingerprints
    are cut into blocks, and each choice of ``blocks - radius`` blocks makes a
    table keyed by them.  Bits that differ lie in ``radius`` blocks at most, so
    a near pair agrees on the front of some table; whole distances are
    verified there.  A pair is given once: in the first table whose blocks are
    all equal.  More blocks make longer keys and more tables; with six, a key has
    about 32 bits, so chance meetings stay few beyond billions of rows.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("there must be more blocks than differing bits")
    fronts = list(combinations(range(blocks), blocks - radius))
    first = [next((at for at, front in enumerate(fronts) if all(equal >> b & 1 for b in front)), -1) for equal in range(1 << blocks)]
    known = prints.select("fp").where(F.col("fp").isNotNull()).distinct()
    asked = queries.select(F.col("fp").alias("query")).where(F.col("query").isNotNull()).distinct()
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    equal = sum(F.when(differ.bitwiseAND(F.lit(_signed(mask << at))) == 0, 1 << b).otherwise(0) for b, (at, mask) in enumerate(_blocks(blocks)))
    one = F.element_at(F.array(*[F.lit(t) for t in first]), equal + 1) == F.col("t")
    left = _tables(asked, "query", radius, blocks).select("query", F.col("table").alias("t"), F.col("key").alias("k"))
    right = _tables(known, "fp", radius, blocks)
    met = (F.col("t") == F.col("table")) & (F.col("k") == F.col("key")) & (F.bit_count(differ) <= radius) & one
    return left.join(right, met).select("query", "fp", F.bit_count(differ).alias("distance"))


def count_near(prints: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``prints`` with n_near: how many other rows lie within ``radius`` bits; null where ``asked`` does not hold.

    Rows with the same fingerprint are counted first, so copies are never paired.
    """
    sizes = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(asked, F.lit(False))).alias("asked")), "print-sizes")
    found = near_fingerprints(sizes.where("asked"), sizes, radius, blocks)
    near = found.join(sizes.select("fp", "rows"), "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("rows") - 1).alias("n_near"))
    return prints.join(near, "fp", "left").withColumn("n_near", F.when(asked, F.col("n_near")))
