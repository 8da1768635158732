"""Pieces of texts between spaces, counted in Arrow batches inside the tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

HELD = 1 << 19  # different rows that a task keeps before it hands them on
ROWS_OUT = 1 << 16
BYTES_AT_ONCE = 1 << 25  # of texts, whose pieces are held at once


def slices(batch: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with not much more than ``BYTES_AT_ONCE`` of text."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(sizes.searchsorted(before + BYTES_AT_ONCE, side="right")))
        yield at, end - at
        at = end


def pieces_of(text: pa.Array) -> tuple[pa.DictionaryArray, pa.Array]:
    """The pieces of all texts, encoded, and the number of the text of each."""
    cut = pc.split_pattern(text, " ")
    return pc.list_flatten(cut).dictionary_encode(), pc.list_parent_indices(cut).cast(pa.int32())


def _added(tables: Sequence[pa.Table], by: Sequence[str]) -> pa.Table:
    names = [*by, "_piece"]
    together = pa.concat_tables(tables)
    if any(pa.types.is_nested(together.schema.field(c).type) for c in by):
        return together  # no keys of Arrow's; equal rows meet later
    summed = together.group_by(names, use_threads=False).aggregate([("_n", "sum")])
    return summed.rename_columns({"_n_sum": "_n"}).select([*names, "_n"])


def _counted(rows: pa.RecordBatch, by: Sequence[str]) -> pa.Table:
    pieces, parents = pieces_of(rows.column(len(by)))
    if not by:
        return pa.table({"_piece": pieces.dictionary, "_n": np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary))})
    keys = {c: rows.column(i) for i, c in enumerate(by)}
    if any(pa.types.is_nested(k.type) for k in keys.values()):
        coded, unit = {"_row": parents}, None
    else:
        unit = {c: k.dictionary_encode(null_encoding="encode") for c, k in keys.items()}
        coded = {c: k.indices.take(parents) for c, k in unit.items()}
    found = pa.table({**coded, "_code": pieces.indices}).group_by([*coded, "_code"], use_threads=False).aggregate([([], "count_all")])
    shown = {c: (keys[c].take(found["_row"].combine_chunks()) if unit is None else unit[c].dictionary.take(found[c].combine_chunks()))
             for c in by}
    return pa.table({**shown, "_piece": pieces.dictionary.take(found["_code"].combine_chunks()), "_n": found["count_all"]})


def piece_counts(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """``(*by, _piece, _n)``: how often each piece stands in the texts, still to be added up over tasks.

    A task counts whole batches and keeps at most about ``HELD`` different
    rows.  Null texts have no pieces.  The other columns are not read.
    """
    by = list(by)
    read = df.select(*by, text)
    schema = T.StructType([*read.schema.fields[: len(by)], T.StructField("_piece", T.StringType()), T.StructField("_n", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for start, length in slices(batch, batch.column(len(by))):
                held.append(_counted(batch.slice(start, length), by))
                size += held[-1].num_rows
                if size > 2 * HELD:
                    held = [_added(held, by)]
                    size = held[0].num_rows
                    if size > HELD:
                        yield from held[0].combine_chunks().to_batches(ROWS_OUT)
                        held, size = [], 0
        if held:
            yield from _added(held, by).combine_chunks().to_batches(ROWS_OUT)

    return read.mapInArrow(count, schema)


def _maybe_listed(pieces: pa.Array, words: Sequence[str]) -> pa.Array:
    """Whether a piece may hold one of the words: no such piece is missed.

    A plain word is its own token.  Of the others those are taken that hold a
    word anywhere in lower case, and those that start like handles and links.
    Where a word is not ASCII, lower case may depend on the engine, so every
    piece that is not ASCII is taken too.
    """
    plain = pc.and_(pc.match_substring_regex(pieces, "^[a-z0-9]+$"), pc.invert(pc.starts_with(pieces, "http")))
    holds = pc.match_substring_regex(pieces, "^(?:@|http)")
    lower = pc.utf8_lower(pieces)
    for word in words:
        for form in (pieces, lower):
            holds = pc.or_(holds, pc.match_substring(form, word))
    if not all(word.isascii() for word in words):
        holds = pc.or_(holds, pc.invert(pc.string_is_ascii(pieces)))
    return pc.if_else(plain, pc.is_in(pieces, pa.array(words, pa.string())), holds)


def listed_piece_counts(df: DataFrame, by: Sequence[str], text: str, words: Sequence[str]) -> DataFrame:
    """As ``piece_counts``, with only the pieces that may hold one of a few words, in one reading of the texts."""
    by, words = list(by), sorted(words)
    read = df.select(*by, text)
    schema = T.StructType([*read.schema.fields[: len(by)], T.StructField("_piece", T.StringType()), T.StructField("_n", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in slices(batch, batch.column(len(by))):
                rows = batch.slice(start, length)
                pieces, parents = pieces_of(rows.column(len(by)))
                chosen = _maybe_listed(pieces.dictionary, words).to_numpy(zero_copy_only=False)
                codes = pieces.indices.to_numpy()
                at = np.flatnonzero(chosen[codes]) if len(chosen) else np.zeros(0, np.int64)
                cells = parents.to_numpy()[at].astype(np.int64) * max(1, len(chosen)) + codes[at]
                cells, counts = np.unique(cells, return_counts=True)
                row, code = np.divmod(cells, max(1, len(chosen)))
                found = [rows.column(i).take(pa.array(row)) for i in range(len(by))]
                found += [pieces.dictionary.take(pa.array(code)), pa.array(counts, pa.int64())]
                yield from pa.Table.from_arrays(found, [*by, "_piece", "_n"]).to_batches(ROWS_OUT)

    return read.mapInArrow(count, schema)
