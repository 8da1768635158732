"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from agorasift.llm.storage import fresh, stored

WINDOW = 10
WINDOWS_PER_BLOCK = 100_000  # of the benchmark, sent to the tasks at once

# word characters are 0-9, a-z (after lower-casing) and all bytes of characters beyond ASCII
_BLANKED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANKED).split()


class WuManber:
    """Patterns of one length in words, found in a list of words.

    The shift table has, for each pair of neighbouring words in a pattern, how
    far its last occurrence is from the pattern's end; a pair in no pattern
    lets the search jump by nearly the whole length.  At shift zero the bucket
    of that suffix gives the patterns to compare in full.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.furthest = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block: end]
                self.shift[block] = min(self.shift.get(block, self.furthest), self.length - end)
            self.buckets[pattern[-self.block:]].append((list(pattern), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of each occurrence, from left to right."""
        length, block, furthest, jump = self.length, self.block, self.furthest, self.shift.get
        end = length
        while end <= len(words):
            suffix = tuple(words[end - block: end])
            step = jump(suffix, furthest)
            if step:
                end += step
                continue
            for pattern, items in self.buckets[suffix]:
                if words[end - length: end] == pattern:
                    yield end - length, items
            end += 1


def windows_of(text: bytes, size: int = WINDOW) -> Iterator[list[bytes]]:
    """The windows of a benchmark item: ``size`` words each, or all words of a shorter item."""
    words = words_of(text)
    if words:
        for at in range(max(1, len(words) - size + 1)):
            yield words[at: at + size]


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id as text, window): every distinct window of every item."""
    read = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = {b" ".join(w) for w in windows_of(text or b"", size)}
                items += [item] * len(found)
                windows += [w.decode() for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item_id", "window"])

    return read.mapInArrow(work, "item_id string, window string").distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """All columns of ``docs`` and n_words, hits (word spans: start, end, ...) and items.

    Benchmark windows are dealt into blocks of about ``per_block`` by hash; one
    block at a time is sent to the tasks, so what is broadcast is bounded and a
    larger benchmark means more passes over the documents.  Spans are merged
    and ordered; items are the distinct ids with an occurrence.  Documents are
    never shuffled.

    Defined cases: a null or empty text has no words, as document or as item;
    windows of an item with a null id hit, but it is not among the items;
    repeated items share their windows;
    an empty benchmark hits nothing; repeated rows are judged alike; columns
    of ``docs`` with the names of results keep them, results get a leading
    underscore.
    """
    n_words, hits, items = fresh(docs, "n_words", "hits", "items")
    windows = stored(benchmark_windows(benchmark, size), "windows")
    blocks = max(1, -(-windows.count() // per_block))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = docs.withColumns({
        n_words: F.lit(0).cast("long"), hits: F.array().cast("array<int>"), items: F.array().cast("array<string>")})
    for at in range(blocks):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for row in windows.where(block == at).toLocalIterator():
            pattern = tuple(row["window"].encode().split(b" "))
            ids = by_length[len(pattern)][pattern]
            if row["item_id"] is not None:
                ids.append(row["item_id"])
        patterns = docs.sparkSession.sparkContext.broadcast([dict(p) for p in by_length.values()])
        found = _search(found, patterns, n_words, hits, items)
    return found


def _search(docs: DataFrame, patterns, n_words: str, hits: str, items: str) -> DataFrame:
    names = docs.columns
    kinds = {n_words: pa.int64(), hits: pa.list_(pa.int32()), items: pa.list_(pa.string())}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [WuManber(p) for p in patterns.value]
        for batch in batches:
            texts = batch.column(names.index("text")).cast(pa.binary())
            spans, ids = batch.column(names.index(hits)), batch.column(names.index(items))
            out = {n_words: [], hits: [], items: []}
            for at in range(len(batch)):
                words = words_of(texts[at].as_py() or b"")
                old = spans[at].as_py()
                starts = list(zip(old[::2], old[1::2], strict=True))
                seen = set(ids[at].as_py())
                for table in tables:
                    for start, of in table.find(words):
                        starts.append((start, start + table.length))
                        seen.update(of)
                out[n_words].append(len(words))
                out[hits].append(merged(starts))
                out[items].append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], kinds[c]) if c in out else batch.column(i) for i, c in enumerate(names)], names=names)

    return docs.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Start, end, start, end, ... of the union of spans."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def n_hit(hits: str):
    """Words inside the merged spans."""
    return F.aggregate(
        F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; same columns."""
    found = find_windows(docs, benchmark, size)
    hits = found.columns[len(docs.columns) + 1]
    return found.where(F.size(hits) == 0).select(*docs.columns)


