"""Running sums in parts that merge geometrically, under one manifest.

Every batch of a stream adds one part.  Parts of one size class merge into one
of the next class as soon as ``fan`` of them are there, so after n batches at
most (fan - 1) parts a class are left, about (fan - 1) * log(n) / log(fan),
and each row is written again once a class.

Readers see a *version*: one small file that lists the parts and the last batch
in them.  A version is written only after all its parts are, and never changed.
A batch that stops halfway leaves files that no version names; run again, it
writes new ones.  A batch that a version already holds is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

_VERSION = "version long, batch long, part string, level int, first_batch long, last_batch long"


@dataclass(frozen=True)
class Part:
    """Sums over the batches ``first_batch`` to ``last_batch``."""

    part: str
    level: int
    first_batch: int
    last_batch: int


@dataclass(frozen=True)
class Version:
    version: int
    batch: int  # last one held
    parts: tuple[Part, ...]


@dataclass(frozen=True)
class RunningSums:
    """Sums of ``value`` by ``keys`` under a folder that the cluster shares.

    One writer at a time, as Structured Streaming has it; any number of readers.
    Null keys are keys like any other, and a key whose values are all null has
    the sum null.
    """

    root: str
    keys: tuple[str, ...]
    value: str
    fan: int = 4
    kept_versions: int = 3  # whose parts stay for readers that have begun

    def __post_init__(self) -> None:
        if self.fan < 2 or self.kept_versions < 1:
            raise ValueError("parts merge by two or more, and one version stays at least")

    # versions

    def _files(self, spark: SparkSession):
        """Spark's own view of the folder, whatever store holds it."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, spark: SparkSession, *names: str):
        return spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root.rstrip("/"), *names)))

    def _versions(self, spark: SparkSession) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        files, folder = self._files(spark), self._path(spark, "versions")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        return [n for n in numbers if files.exists(self._path(spark, "versions", f"version={n}", "_SUCCESS"))]

    def _read(self, spark: SparkSession, number: int) -> Version:
        """A version's list: one row per part, at most ``fan`` a size class."""
        rows = spark.read.schema(_VERSION).json(f"{self.root.rstrip('/')}/versions/version={number}").collect()
        parts = [Part(r.part, r.level, r.first_batch, r.last_batch) for r in rows if r.part is not None]
        return Version(number, rows[0].batch, tuple(sorted(parts, key=lambda p: p.first_batch)))

    def latest(self, spark: SparkSession) -> Version | None:
        numbers = self._versions(spark)
        return self._read(spark, numbers[-1]) if numbers else None

    def _publish(self, spark: SparkSession, version: Version) -> None:
        """Spark marks the folder complete as its last step; until then readers take the version before."""
        rows = [(version.version, version.batch, p.part, p.level, p.first_batch, p.last_batch) for p in version.parts]
        rows = rows or [(version.version, version.batch, None, None, None, None)]
        listed = spark.createDataFrame(rows, _VERSION).coalesce(1)
        listed.write.mode("overwrite").json(f"{self.root.rstrip('/')}/versions/version={version.version}")

    # parts

    def _load(self, spark: SparkSession, parts: Sequence[Part], schema) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.root.rstrip('/')}/parts/{p.part}" for p in parts])

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))

    def _store(self, rows: DataFrame, level: int, first: int, last: int) -> Part:
        name = f"level{level}-{first}-{last}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root.rstrip('/')}/parts/{name}")
        return Part(name, level, first, last)

    def _merged(self, spark: SparkSession, parts: list[Part], schema) -> list[Part]:
        """The newest ``fan`` parts of one class become one of the next, as long as there are so many."""
        while len(parts) >= self.fan and len({p.level for p in parts[-self.fan:]}) == 1:
            newest = parts[-self.fan:]
            rows = self._summed(self._load(spark, newest, schema))
            whole = self._store(rows, newest[0].level + 1, newest[0].first_batch, newest[-1].last_batch)
            parts = [*parts[: -self.fan], whole]
        return parts

    def add(self, batch: DataFrame, number: int) -> None:
        """Take a batch in; nothing happens if a version already holds it.

        Batches come with rising numbers.
        """
        spark = batch.sparkSession
        before = self.latest(spark)
        if before is not None and number <= before.batch:
            return
        sums = self._summed(batch.select(*self.keys, self.value))
        parts = [*(before.parts if before else ()), self._store(sums, 0, number, number)]
        after = Version(before.version + 1 if before else 0, number, tuple(self._merged(spark, parts, sums.schema)))
        self._publish(spark, after)
        self.clean(spark)

    def clean(self, spark: SparkSession) -> None:
        """Remove versions but the last ones, and parts that none of these names."""
        files, numbers = self._files(spark), self._versions(spark)
        kept = numbers[-self.kept_versions:]
        for number in numbers[: -self.kept_versions]:
            files.delete(self._path(spark, "versions", f"version={number}"), True)
        named = {p.part for n in kept for p in self._read(spark, n).parts}
        folder = self._path(spark, "parts")
        for status in files.listStatus(folder) if kept and files.exists(folder) else ():
            if status.getPath().getName() not in named:
                files.delete(status.getPath(), True)

    def totals(self, spark: SparkSession, schema) -> DataFrame:
        """Sums over all batches of the latest version; ``schema`` is that of the sums."""
        version = self.latest(spark)
        if version is None or not version.parts:
            return spark.createDataFrame([], schema)
        return self._summed(self._load(spark, version.parts, schema))
