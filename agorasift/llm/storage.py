"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agorasift.operators.durable import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[list[str]] = []  # paths of the open ``tidy`` blocks, innermost last


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and go on from there.

    Cuts the lineage: a lost executor costs a re-read of this table.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``; also the path, for ``discard``.

    What the write shuffled is not needed again, so Spark is asked to remove
    those files when it ends instead of when the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``stored_at`` wrote and that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside the block go when it ends; those stored by the given function stay."""
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table, path = stored_at(df, name)
        kept.append(path)
        return table

    _WRITTEN.append([])
    try:
        yield keep
    finally:
        for path in _WRITTEN.pop():
            if path not in kept:
                discard(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its id and text; never null.

    Rows equal in both share the key, and every operator treats them alike.
    """
    return F.xxhash64(doc_id, text), F.xxhash64(text, F.lit(1), doc_id)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
