"""Removal of long repeated byte strings with a logarithmic family of suffix indexes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from agorasift.llm.arrow import map_texts
from agorasift.llm.decontaminate import merged
from agorasift.llm.storage import discard, fresh, row_key, stored, stored_at

LENGTH = 400  # bytes of a string that counts as long
GRAM = 128  # bytes of the strings among which each window chooses its place
CELL = 16  # neighbouring windows that are tested by what they have in common
BATCHES = 4
AT_ONCE = 1 << 18  # windows of a very long text that are worked on together

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MIX = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, most: int) -> np.ndarray:
    if len(_powers.get(base, ())) < most:
        factors = np.full(max(most, AT_ONCE + 2 * LENGTH), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:most]


def gram_hashes(text: bytes, size: int) -> np.ndarray:
    """A hash of each string of ``size`` bytes, from its content alone."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _powers_of(_BASE, len(data)), out=sums[1:])
    grams = (sums[size:] - sums[:-size]) * _powers_of(pow(_BASE, -1, 1 << 64), len(data) - size + 1)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(_MIX)
    return grams ^ (grams >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    rows = np.concatenate([values, np.full(-len(values) % width, values[-1])]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(values) - width + 1
    return np.minimum(behind[:last], ahead[width - 1: width - 1 + last])


def runs_of_windows(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of windows of ``length`` bytes that choose the same place, and its hash.

    A window chooses the leftmost smallest gram inside it, so equal windows
    choose alike wherever they stand.  A run ends where that gram changes or
    leaves the window.
    """
    grams = gram_hashes(text, gram)
    least = sliding_minimum(grams, length - gram + 1)
    change = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    first = np.concatenate(([0], np.flatnonzero(change) + 1))
    return first, np.append(first[1:] - 1, len(least) - 1), least[first]


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def suffix_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, first, last, key, content): the runs of windows of every text.

    ``key`` is the hash of the chosen gram and ``content`` that of all bytes
    from the run's first window to the end of its last one.
    """
    runs = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "key", "content")]))

    def one(text: bytes):
        found = []
        for at in range(0, len(text) - length + 1, AT_ONCE):
            part = text[at: at + AT_ONCE + length - 1]
            first, last, key = runs_of_windows(part, length, gram)
            digest = xxhash.xxh3_64_intdigest
            content = np.array([digest(part[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
            found += zip((first + at).tolist(), (last + at).tolist(), _signed(key), _signed(content), strict=True)
        return ([dict(zip(("first", "last", "key", "content"), r, strict=True)) for r in found],)

    listed = map_texts(docs, "text", ["k1", "k2"], T.StructType([T.StructField("runs", runs)]), lambda: one)
    return listed.select("k1", "k2", F.inline("runs"))


class SuffixIndex:
    """Sorted runs of suffixes in levels that grow geometrically.

    The suffixes are those at chosen places, one per run of windows, in the
    order of (key, content): a sparse suffix array whose neighbours with equal
    keys share the gram and with equal contents share all windows of a run.
    A new batch is sorted, merge-scanned against every level for keys they
    share, and becomes a level; levels of equal size are merged into one of
    twice the size, so n batches leave log n levels and each row is rewritten
    log n times.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.matches: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """``batch``: suffix_runs rows.  Keys met in a level, or twice in the batch, are noted."""
        level, path = stored_at(self._sorted(batch.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"))), "level")
        met = [level.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")]
        met += [level.join(old.select("key"), "key", "left_semi").select("key") for _, old, _ in self.levels]
        for keys in met:
            self.matches.append(stored(keys.distinct(), "met"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old, old_path = self.levels.pop()
            together = old.union(level).groupBy("key", "content").agg(F.sum("n").alias("n"))
            level, merged_path = stored_at(self._sorted(together), "level")
            for done in (path, old_path):
                discard(self.spark, done)
            size, path = 2 * size, merged_path
        self.levels.append((size, level, path))

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("key", "content")

    def matched(self) -> DataFrame:
        """(key, content, n, several) of all suffixes with a noted key; several: the key has other contents too."""
        keys = self.matches[0]
        for more in self.matches[1:]:
            keys = keys.union(more)
        keys = stored(keys.distinct(), "keys")
        rows = self.levels[0][1]
        for _, more, _ in self.levels[1:]:
            rows = rows.union(more)
        rows = rows.join(keys, "key", "left_semi").groupBy("key", "content").agg(F.sum("n").alias("n"))
        rows = stored(rows, "suffixes")
        contents = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("contents")), "contents")
        return rows.join(contents, "key").select("key", "content", "n", (F.col("contents") > 1).alias("several"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(k1, k2, start, end): byte spans that together hold all repeated strings of ``length`` bytes.

    ``keyed`` has k1, k2 and text.  Runs whose whole content stands elsewhere
    are spans as they are.  Where a key has several contents, the windows of
    one example of each content are compared: in cells of neighbouring windows
    by what these have in common first, then window by window in the cells
    that are left.
    """
    spark = keyed.sparkSession
    runs, runs_path = stored_at(suffix_runs(keyed, length, gram), "runs")
    index = SuffixIndex(spark)
    for at in range(batches):
        index.add(runs.where(F.pmod("k1", F.lit(batches)) == at))
    matched = stored(index.matched(), "matched")
    found = stored(runs.join(matched, ["key", "content"]), "found")
    discard(spark, runs_path)
    for _, _, path in index.levels:
        discard(spark, path)
    whole = found.where("n > 1").select("k1", "k2", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    one = F.min(F.struct("k1", "k2", "first", "last")).alias("at")
    examples = found.where("several").groupBy("key", "content").agg(one, F.max("n").alias("n"))
    examples = stored(examples.select("at.*", "key", "content", "n"), "examples")
    return whole.union(_shared_windows(keyed, examples, length, gram))


def _shared_windows(keyed: DataFrame, examples: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of windows that two contents or more hold, in those that stand once."""
    wanted = examples.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "key", "content", "n")).alias("wanted"))
    texts = keyed.join(stored(wanted, "wanted"), ["k1", "k2"])
    pieces = stored(_pieces(texts, length, gram), "pieces")
    core = length - CELL + 1
    cells = stored(_hashed(pieces, core, CELL), "cells")
    held = cells.groupBy("key", "hash").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
    left = cells.join(stored(held.select("key", "hash"), "held"), ["key", "hash"], "left_semi")
    left = left.groupBy("key", "content").agg(F.collect_set("offset").alias("cells"))
    left = pieces.join(stored(left, "cells-left"), ["key", "content"])
    windows = stored(_hashed(left, length, 1), "windows")
    held = windows.groupBy("key", "hash").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
    hit = windows.join(stored(held.select("key", "hash"), "held"), ["key", "hash"], "left_semi")
    hit = hit.groupBy("key", "content").agg(F.collect_set("offset").alias("offsets"))
    single = examples.where("n = 1").join(stored(hit, "hit"), ["key", "content"])
    place = pieces.select("key", "content", "chosen").distinct()
    starts = single.join(place, ["key", "content"]).select("k1", "k2", (F.col("chosen") + F.col("first")).alias("at"), F.explode("offsets").alias("o"))
    return starts.select("k1", "k2", (F.col("at") - F.col("o")).alias("start"), (F.col("at") - F.col("o") + length).alias("end"))


def _pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, content, chosen, windows, piece): bytes of each example; chosen: where its gram stands in them."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted"), strict=True):
                whole = text.as_py() or b""
                for run in wanted.as_py():
                    piece = whole[run["first"]: run["last"] + length]
                    values = (run["key"], run["content"], int(gram_hashes(piece[:length], gram).argmin()),
                              run["last"] - run["first"] + 1, piece)
                    for held, value in zip(out, values, strict=True):
                        held.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                                             ["key", "content", "chosen", "windows", "piece"])

    return texts.select("text", "wanted").mapInArrow(work, "key long, content long, chosen int, windows int, piece binary")


def _hashed(pieces: DataFrame, length: int, step: int) -> DataFrame:
    """(key, content, hash, offset): strings of ``length`` bytes by their offset before the chosen gram.

    With ``step`` over one, offsets are cells of that many windows and the
    string is the part that all windows of the cell hold.  With one, only
    windows in the listed ``cells`` are given.
    """
    listed = "cells" in pieces.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            cells = batch.column("cells").to_pylist() if listed else [None] * len(batch)
            for key, content, chosen, windows, piece, only in zip(
                    *(batch.column(c).to_pylist() for c in ("key", "content", "chosen", "windows", "piece")), cells, strict=True):
                low, high = chosen - windows + 1, chosen  # offsets of its last and first window
                if listed:
                    offsets = [o for c in only for o in range(max(low, c * CELL), min(high, c * CELL + CELL - 1) + 1)]
                else:
                    offsets = range(low // step, high // step + 1)
                for offset in offsets:
                    start = chosen - offset * step
                    out[0].append(key)
                    out[1].append(content)
                    out[2].append(xxhash.xxh3_64_intdigest(piece[start: start + length], offset) - (1 << 63))
                    out[3].append(offset)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                                             ["key", "content", "hash", "offset"])

    return pieces.mapInArrow(work, "key long, content long, hash long, offset int")


def drop_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Columns of ``docs`` without text, and n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte is removed if a string of ``length`` bytes over it also starts
    anywhere else in the table, in the same text included.  Texts are UTF-8
    bytes, so what is kept may cut a character and is binary.

    The method named for this operator sorts suffixes; here the suffixes are
    those at places that the content itself chooses (about one in
    ``(length - gram) / 2`` bytes), which finds every repeated string of
    ``length`` bytes, since both occurrences choose the same place.  Strings
    are compared by 128 bits of hashes.

    Defined cases: a null or empty text has no bytes, and texts shorter than
    ``length`` stay whole; repeated rows repeat each other and lose all that is
    long enough; null ids are rows like others; an empty table gives an empty
    table; clashing column names get a leading underscore.
    """
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text").where(F.octet_length("text") >= length)
    spans = repeated_spans(keyed, length, gram, batches)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    n1, n2, held = fresh(docs, "k1", "k2", "spans")
    spans = stored(spans.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("spans").alias(held)), "spans")
    joined = docs.withColumns({n1: k1, n2: k2}).join(spans, [n1, n2], "left").drop(n1, n2)
    return _cut(joined, held)


def _cut(docs: DataFrame, spans: str) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", spans)]
    names = fresh(docs.drop("text", spans), "n_bytes", "n_removed", "n_spans", "kept")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column(spans), strict=True):
                whole = text.as_py() or b""
                ends = merged([(s["start"], s["end"]) for s in found.as_py() or ()])
                borders = [0, *ends, len(whole)]
                kept = b"".join(whole[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
                for held, value in zip(out, (len(whole), len(whole) - len(kept), len(ends) // 2, kept), strict=True):
                    held.append(value)
            columns = [batch.column(c) for c in keep] + [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, keep + names)

    schema = T.StructType([*[docs.schema[c] for c in keep], *[
        T.StructField(n, T.BinaryType() if n == names[3] else T.LongType()) for n in names]])
    return docs.select(*keep, "text", spans).mapInArrow(work, schema)
