"""Day-partitioned tables: reading ranges, adding days once, summaries per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from agorasift.functions import dates as D

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
MOST_WRITERS = 32  # files that Spark packs into one task by its default sizes


def read_days(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
              schema: StructType | None = None) -> DataFrame:
    """Days of a partitioned table; missing or vanished files are ignored.

    The range test is on the partition column, so other days are never listed
    by a task.
    """
    reader = spark.read.option("ignoreMissingFiles", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return experiment_slice(reader.parquet(path), start, end)


def experiment_slice(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """Rows of the days from ``start`` to ``end``, both included."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def known_days(spark: SparkSession, path: str) -> DataFrame | None:
    """Days already in the table, or None when there is no table yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).select("date").distinct()


def write_days(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a day-partitioned table.

    Days already present are skipped, or replaced one by one with ``overwrite``.
    """
    if overwrite:
        _few_files(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        return
    present = known_days(df.sparkSession, path)
    if present is not None:
        df = df.join(present, "date", "left_anti")
    _few_files(df).write.mode("append").partitionBy("date").parquet(path)


def _few_files(df: DataFrame) -> DataFrame:
    """Rows of a day together; adaptive execution splits a day that is too large for one task."""
    return df.hint("rebalance", "date")


def import_day(posts: DataFrame, day: str, zone: str, days: int = 1, instant: str = "created_at") -> DataFrame:
    """Posts of local calendar days, whatever the clock does on them."""
    local = D.local_day(F.col(instant), zone)
    first = F.lit(day).cast("date")
    return posts.where(local.between(first, F.date_add(first, days - 1)))


def import_files(spark: SparkSession, paths: Sequence[str], target: str) -> DataFrame:
    """Any set of files as one named target partition."""
    return spark.read.parquet(*paths).withColumn("target", F.lit(target))


def summarise_days(df: DataFrame, path: Column, **measures: Column) -> DataFrame:
    """One record per day named in the file path."""
    return df.groupBy(D.date_from_path(path).alias("date")).agg(*[m.alias(n) for n, m in measures.items()])


def json_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType) -> DataFrame:
    """Convert JSON lines to parquet, a folder per source file; returns the rows written per file.

    Broken lines are left out.  The source is read once; the counts come from
    the written table's partitions.
    """
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("mode", "DROPMALFORMED").json(source)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # a writer for each file of a task, so that rows are not sorted by file
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(MOST_WRITERS))
    try:
        rows.select("*", file.alias("file")).write.mode("overwrite").partitionBy("file").parquet(target)
    finally:
        spark.conf.set(WRITERS, before)
    return spark.read.parquet(target).groupBy(F.col("file").cast("string").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
