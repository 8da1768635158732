"""Importance resampling of documents towards a target collection.

Features are runs of neighbouring words, hashed to buckets by their CRC-32.
A block of texts gets an Aho-Corasick dictionary of its distinct words, each
bounded by delimiters; a hit gives the word's payload, its CRC and length, and
the CRC of a run is composed from the payloads next to each other, so no run
is ever cut out of the text or hashed byte by byte.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from agorasift.llm.storage import discard, fresh, row_key, stored, stored_at
from agorasift.operators.ranking import number_rows

BLOCK_BYTES = 1 << 22  # of texts that share a dictionary; a longer text has its own
POLYNOMIAL = 0xEDB88320  # of CRC-32

# word characters are 0-9, a-z (A-Z lower-cased) and all bytes of characters beyond ASCII
_FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def _byte_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(POLYNOMIAL), steps >> 1)
    return steps


_STEP = _byte_steps()


def _through(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, held as one table per byte, over many values."""
    parts = [tables[k][crcs >> np.uint32(8 * k) & np.uint32(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


@lru_cache(maxsize=64)
def _doubled(power: int) -> np.ndarray:
    """The map that appends 2**power zero bytes to what a CRC stands for."""
    if power:
        half = _doubled(power - 1)
        return np.stack([_through(half, t) for t in half])
    values = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    return (values >> np.uint32(8)) ^ _STEP[values & np.uint32(255)]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes as ``lengths`` says, value by value."""
    crcs, power = crcs.copy(), 0
    while len(lengths) and int(lengths.max()) >> power:
        due = (lengths >> power & 1).astype(bool)
        if due.any():
            crcs[due] = _through(_doubled(power), crcs[due])
        power += 1
    return crcs


class Dictionary:
    """Automaton over distinct words; a hit is the place of the word's payload."""

    def __init__(self, words: Iterable[bytes]):
        words = list(words)
        self.alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.after = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))  # with the blank before it
        self.length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for place, word in enumerate(words):
            self.machine.add_word(f" {word.decode('latin-1')} ", place)
        if words:
            self.machine.make_automaton()

    def places(self, text: str) -> np.ndarray:
        """Places of the words of a text in which every word stands between blanks."""
        if not len(self.alone) or len(text) < 3:
            return np.zeros(0, np.int64)
        return np.fromiter(map(itemgetter(1), self.machine.iter(text)), np.int64)

    def run_crcs(self, places: np.ndarray, most_words: int) -> Iterator[np.ndarray]:
        """CRC-32 of all runs of one word, of two, and so on."""
        crcs = self.alone[places]
        for size in range(1, most_words + 1):
            if size > 1:
                last = places[size - 1:]
                crcs = shifted(crcs[:len(last)], self.length[last]) ^ self.after[last]
            if len(crcs):
                yield crcs


def run_buckets(texts: Sequence[bytes], most_words: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of all runs) of each text of a block."""
    split = [t.translate(_FOLDED).split() for t in texts]
    dictionary = Dictionary(set().union(*split))
    for words in split:
        places = dictionary.places(f" {b' '.join(words).decode('latin-1')} ")
        runs = [c % np.uint32(buckets) for c in dictionary.run_crcs(places, most_words)]
        yield len(places), np.concatenate(runs) if runs else np.zeros(0, np.uint32)


def _blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts (null: empty) in blocks of about ``BLOCK_BYTES``, in order."""
    block, held = [], 0
    for text in texts.cast(pa.binary()):
        block.append(text.as_py() or b"")
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _stored_as(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def hashed_runs(docs: DataFrame, keep: Sequence[str], most_words: int, buckets: int) -> DataFrame:
    """The kept columns, n_words and ``runs``: the buckets of all runs of the text, two or four bytes each.  No shuffle."""
    kept, kind = [docs.schema[c] for c in keep], _stored_as(buckets)
    names = [*keep, "n_words", "runs"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], []
            for block in _blocks(batch.column(batch.num_columns - 1)):
                for words, runs in run_buckets(block, most_words, buckets):
                    n_words.append(words)
                    found.append(runs.astype(kind).tobytes())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], names=names)

    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.BinaryType())]
    return docs.select(*keep, "text").mapInArrow(work, T.StructType([*kept, *added]))


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Runs of all texts in each bucket.

    Each task sums its own texts, and the driver gets one number per bucket.
    """
    kind = _stored_as(buckets)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for runs in batch.column(0):
                sums += np.bincount(np.frombuffer(runs.as_py(), kind), minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums[found], pa.int64())], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for row in hashed.select("runs").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of target to source shares of each bucket, one run added to each, floored."""
    all_source, all_target, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(hashed: DataFrame, gains: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """The kept columns, n_features and weight: the floored mean gain of a text's runs, 0 without runs.  No shuffle."""
    kind, names = _stored_as(len(gains)), [*keep, "n_features", "weight"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_features, weights = [], []
            for runs in batch.column(batch.num_columns - 1):
                of = gains[np.frombuffer(runs.as_py(), kind)]
                n_features.append(len(of))
                weights.append(int(of.sum()) // len(of) if len(of) else 0)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n_features, pa.int64()), pa.array(weights, pa.int64())], names=names)

    added = [T.StructField(n, T.LongType()) for n in ("n_features", "weight")]
    return hashed.select(*keep, "runs").mapInArrow(work, T.StructType([*[hashed.schema[c] for c in keep], *added]))


def resample(
    docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """One row per document: doc_id, k1, k2 (row key), n_words, n_features, weight, score, rank.

    Both tables need a column ``text``.  A document's weight is the mean gain
    of its runs of up to ``most_words`` words; its score adds Gumbel noise from
    a hash of the id, so taking the highest scores draws without replacement
    in proportion to the weights.  Of the documents with ``least_words`` words
    or more, ``percent`` in a hundred (rounded down) are drawn and ranked from
    1; others have no rank.

    Defined cases: null and empty texts have no words, weight 0 and no rank; a
    null id is hashed as empty text and comes last among equal scores; equal
    ids are put in order by row key; rows equal in id and text share a score
    and take neighbouring ranks; an empty target gives each bucket the gain of
    no runs; an empty table gives an empty table; other columns are not read.

    Texts are scanned once and never shuffled: the buckets of their runs are
    stored, counted, and scored once the gains are known.  Ranks come from a
    range sort of narrow rows, which spreads equal scores by id.
    """
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed, keys = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text"), ("doc_id", "k1", "k2")
    hashed, path = stored_at(hashed_runs(keyed, keys, most_words, buckets), "resampling-runs")
    gains = bucket_gains(bucket_counts(hashed, buckets), bucket_counts(hashed_runs(target, (), most_words, buckets), buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / float(1 << 32)))).cast("long")
    scored = stored(weigh(hashed, gains, (*keys, "n_words")).withColumn("score", F.col("weight") + noise), "resampling-scores")
    discard(docs.sparkSession, path)
    wanted = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    short = F.col("n_words") < least_words
    ranked = number_rows(scored, [short, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("k1"), F.col("k2")], "rank", start=1)
    return ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))


def draw(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, as they are."""
    k1, k2 = fresh(docs, "k1", "k2")
    chosen = resample(docs, target, **settings).where(F.col("rank").isNotNull())
    chosen = stored(chosen.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "resampling-drawn")
    first, second = row_key(F.col("doc_id"), F.col("text"))
    return docs.withColumns({k1: first, k2: second}).join(chosen, [k1, k2], "left_semi").select(*docs.columns)
