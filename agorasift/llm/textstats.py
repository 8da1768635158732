"""Counts over one whole text, shared by the quality operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agorasift.llm.arrow import map_texts

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_caps_words",
    "n_digits", "n_marks", "n_distinct", "n_short", "n_echo", "n_wide",
)
WINDOW = 5


def _bytes_in(characters: str) -> np.ndarray:
    return np.frombuffer(characters.encode(), np.uint8)


_SYMBOLS, _MARKS, _BLANKS = _bytes_in("#*$%&|<>"), _bytes_in(".,;:!?"), _bytes_in(" \t\n\x0b\f\r")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for at in range(WINDOW):  # equal windows have equal sums; the few others are told apart below
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + numbers[at: at + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    places = np.unique(np.concatenate((order[1:][same], order[:-1][same]))).tolist()
    times = Counter(tuple(words[p: p + WINDOW]) for p in places)
    hit = np.zeros(len(words), bool)
    for p in places:
        if times[tuple(words[p: p + WINDOW])] > 1:
            hit[p: p + WINDOW] = True
    return int(hit.sum())


def counts_of(text: bytes) -> list[int]:
    """The values of ``COUNTS``; words are runs of anything but ASCII blanks."""
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n_chars = len(text) - int(histogram[0x80:0xC0].sum())
    lines, seen, dup = text.split(b"\n"), set(), 0
    for line in lines:
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    distinct = set(words)
    upper = int(histogram[0x41:0x5B].sum())
    caps = sum(w == w.upper() and w != w.lower() for w in words) if upper else 0
    return [
        len(words), n_chars - int(histogram[_BLANKS].sum()), int(histogram[_SYMBOLS].sum()), dup, repeated_words(words),
        n_chars, len(lines), upper, caps, int(histogram[0x30:0x3A].sum()), int(histogram[_MARKS].sum()), len(distinct),
        sum(len(w) <= 3 for w in words), sum(a == b for a, b in zip(words, words[1:])), len(text) - n_chars,
    ]


def text_counts(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns and ``COUNTS`` of the whole text; null is empty.  No shuffle."""
    added = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS])
    return map_texts(docs, "text", keep, added, lambda: counts_of)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def ratios() -> dict[str, Column]:
    """Statistics that do not grow with the text, as expressions over ``COUNTS``.

    ``distinct`` compares logarithms, since long texts repeat more of their words.
    """
    words, chars, lines = F.col("n_words"), F.col("n_chars"), F.col("n_lines")
    return {
        "log_words": F.log1p(words), "word_length": _share(F.col("word_chars"), words),
        "symbols": _share(F.col("n_symbols"), chars), "dup_lines": _share(F.col("n_dup_lines"), lines),
        "repeats": _share(F.col("n_repeat_words"), words), "upper": _share(F.col("n_upper"), chars),
        "caps": _share(F.col("n_caps_words"), words), "digits": _share(F.col("n_digits"), chars),
        "marks": _share(F.col("n_marks"), words), "distinct": _share(F.log1p("n_distinct"), F.log1p(words)),
        "short": _share(F.col("n_short"), words), "echo": _share(F.col("n_echo"), words),
        "wide": _share(F.col("n_wide"), chars), "line_words": _share(words, lines),
    }


def ratio_matrix(counts: np.ndarray) -> np.ndarray:
    """``ratios`` over rows of ``COUNTS``, for scoring inside tasks."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    share = lambda part, whole: np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)
    words, chars, lines = c["n_words"], c["n_chars"], c["n_lines"]
    return np.column_stack([
        np.log1p(words), share(c["word_chars"], words), share(c["n_symbols"], chars), share(c["n_dup_lines"], lines),
        share(c["n_repeat_words"], words), share(c["n_upper"], chars), share(c["n_caps_words"], words),
        share(c["n_digits"], chars), share(c["n_marks"], words), share(np.log1p(c["n_distinct"]), np.log1p(words)),
        share(c["n_short"], words), share(c["n_echo"], words), share(c["n_wide"], chars), share(words, lines),
    ])


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from: crc32 of the id as text, one in five."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out fold.

    The rows are those first in hash order of the id, so the sample is the
    same on every run; their ids are bounded by ``most`` and may be broadcast.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
