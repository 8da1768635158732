"""Incremental form of the ingest steps, with Structured Streaming.

All queries run with ``availableNow``: they take what has arrived since the
last run and stop, so a scheduler can start them every ten minutes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from agorasift.functions import text as T
from agorasift.sources import filters, posts as P
from agorasift.streaming.parts import RunningSums

# Spark's settings for state on local disk, saved as changes of each batch.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
EDGE_SUMS = "layer string, src long, dst long, weight long"


def read_raw(spark: SparkSession, path: str, files_per_batch: int = 144, archive: str | None = None) -> DataFrame:
    """Stream of nested posts from JSON-lines files; read files may be archived."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return P.parse_lines(lines)


def flat_tokens(raw: DataFrame, languages: list[str] | None = None, **tests) -> DataFrame:
    """Expanded, flattened, filtered and tokenised posts; no state.

    ``tests`` are the keyword, location and account tests of
    ``filters.import_filter``; without any, the languages alone decide.
    """
    flat = P.keep_languages(P.expand_embedded(raw), languages)
    if tests:
        flat = filters.import_filter(flat, **tests)
    return flat.withColumn("tokens", T.tokenize(F.col("text")))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for queries that start inside; a query keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once parquet sink for what is there now.

    State, if there is any, is kept on the executors' disks and its changes
    under the checkpoint, so it may outgrow memory and outlives executors.
    """
    with settings(stream.sparkSession, DISK_STATE):
        return (
            stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )


def read_posts(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 144) -> DataFrame:
    """Stream of flat posts from a parquet folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup(posts: DataFrame, delay: str = "1 day", instant: str = "created_at") -> DataFrame:
    """First arrival of each id; state is dropped once the delay has passed."""
    return posts.withWatermark(instant, delay).dropDuplicatesWithinWatermark(["id"])


def tumbling_counts(posts: DataFrame, width: str = "10 minutes", delay: str = "1 hour",
                    instant: str = "created_at") -> DataFrame:
    """Posts per window; windows close after the delay, later rows are dropped."""
    counts = posts.withWatermark(instant, delay).groupBy(F.window(instant, width)).agg(F.count(F.lit(1)).alias("n_posts"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_posts")


def edge_sums(target: str, fan: int = 4) -> RunningSums:
    return RunningSums(target, ("layer", "src", "dst"), "weight", fan)


def running_edges(edges: DataFrame, target: str, checkpoint: str, fan: int = 4) -> StreamingQuery:
    """Edge weights of all batches, in parts that merge geometrically.

    A batch that is run again counts once; ``edge_totals`` reads the parts of
    the last complete version.
    """
    sums = edge_sums(target, fan)
    return (
        edges.writeStream.foreachBatch(sums.add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def edge_totals(spark: SparkSession, target: str) -> DataFrame:
    """Edge weights over all batches so far."""
    return edge_sums(target).totals(spark, EDGE_SUMS)
