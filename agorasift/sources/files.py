"""Result sinks and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet without dictionary encoding."""
    df.write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(path)


def write_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """CSV whose quoting keeps quotes, back-slashes and line breaks as they are."""
    (
        df.write.mode("overwrite").option("compression", compression).option("header", "true")
        .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", "true").option("multiLine", "true")
        .option("quote", '"').option("escape", '"').csv(path)
    )


def merge_annotations(spark: SparkSession, path: str | None, new: DataFrame, target: str) -> DataFrame:
    """Earlier annotations followed by the new ones, written as one CSV table."""
    merged = new
    if path is not None:
        merged = read_csv(spark, path, new.schema).unionByName(new)
    write_csv(merged, target, compression="none")
    return merged


def write_ingest(flat: DataFrame, target: str) -> None:
    """Flat posts as compressed JSON lines, one folder per source file."""
    write_json(flat, target)


def ingest_counts(expanded: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source file: rows after expansion and rows written."""
    total = expanded.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    written = kept.groupBy("file").agg(F.count(F.lit(1)).alias("written"))
    return total.join(written, "file", "left").select(
        "file", "total", F.coalesce("written", F.lit(0)).alias("written")
    )
