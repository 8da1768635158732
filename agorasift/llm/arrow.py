"""Row-wise work on texts inside tasks, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS_AT_ONCE = 64  # texts held as Python objects at a time


def map_texts(
    df: DataFrame, column: str, keep: Sequence[str], added: T.StructType,
    start: Callable[[], Callable[[bytes], Sequence]],
) -> DataFrame:
    """Adds columns computed from one text column, row by row, to the kept ones.

    ``start`` runs once per task and gives the function from the text's UTF-8
    bytes (null: empty) to the added values.  Rows stay in place: no shuffle.
    """
    kept = [df.schema[c] for c in keep]
    read = df.select(*keep, *([] if column in keep else [column]))
    names = list(keep) + [f.name for f in added]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
            values = [[] for _ in kinds]
            for at in range(0, len(texts), ROWS_AT_ONCE):
                for text in texts.slice(at, ROWS_AT_ONCE).to_pylist():
                    for held, value in zip(values, one(text or b""), strict=True):
                        held.append(value)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return read.mapInArrow(work, T.StructType([*kept, *added.fields]))
