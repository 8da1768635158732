"""A corpus pipeline of the training-data operators, from raw documents to a mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agorasift.llm import decontaminate, language, line_dedup, mixing, simhash
from agorasift.llm.storage import discard, stored_at

ORACLE_SQL = None  # a trained model decides in the first stage; tests compare with plain Python


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text, page and host."""
    evidence = language.page_evidence(_table(spark, sf_dir, "pages"))
    return language.drop_unidentified(docs, evidence, language.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document before them holds."""
    return line_dedup.drop_shared_lines(docs).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints linked at four or fewer bits."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with the words it takes of each (repeats counted)."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote, which then goes."""
    docs, path = _table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs, written = stored_at(docs, name)
            if path is not None:
                discard(spark, path)
            path = written
    return docs
