"""Registered queries: a Spark function over the given tables and its SQL check."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from agorasift.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the views over them, loaded when first used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in V.BASE_TABLES:
            df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        elif name in V.SPARK_VIEWS or name in V.VIEWS:
            view = V.SPARK_VIEWS.get(name) or V.VIEWS[name]
            df = self.spark.sql(view.text, **{n: getattr(self, n) for n in view.inputs})
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def stopwords(self) -> list[str]:
        return list(V.STOPWORDS)


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(tables)`` under a name, with SQL over the given views."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLES[name] = V.with_views(sql, views)
        return fn

    return register
