"""Vocabularies and long (row, column, value) matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from agorasift.functions import text as T
from agorasift.functions import urls as U
from agorasift.operators import daily
from agorasift.operators.ranking import distinct_level_quantile, number_rows

# Fixed value: addresses of the platform's own link shortener.
SHORT_LINK = "https://t.co"


def build_vocabulary(df: DataFrame, tokens: Column, to_lower: bool = True) -> DataFrame:
    """Token occurrences, most frequent first."""
    words = F.transform(tokens, lambda t: F.lower(t)) if to_lower else tokens
    return daily.token_frequency(df, words).orderBy(F.desc("frequency"), "token")


def with_token_ids(vocabulary: DataFrame, key: str = "token") -> DataFrame:
    """Dense ids, the most frequent entry first."""
    return number_rows(vocabulary, [F.desc("frequency"), F.asc(key)], "token_id")


def relevant_vocabulary(
    vocabulary: DataFrame,
    min_frequency: int,
    stopwords: DataFrame | Sequence[str] = (),
    remove_punctuation: bool = True,
    remove_short_links: bool = True,
) -> DataFrame:
    """Tokens worth a matrix column, with dense ids by frequency."""
    words = vocabulary
    if remove_punctuation:
        words = words.where(~T.is_punctuation(F.col("token")))
    if remove_short_links:
        words = words.where(~F.col("token").startswith(SHORT_LINK))
    if isinstance(stopwords, DataFrame):
        words = words.join(stopwords.select("token"), "token", "left_anti")
    elif stopwords:
        words = words.where(~F.col("token").isin(*stopwords))
    words = words.groupBy("token").agg(F.sum("frequency").alias("frequency"))
    return with_token_ids(words.where(F.col("frequency") >= min_frequency))


def between_quantile(df: DataFrame, column: str, lowest: float, share: float) -> DataFrame:
    """Rows whose value lies between a minimum and an upper quantile of the column."""
    top = distinct_level_quantile(df, column, share)
    return df.where(F.col(column) >= lowest) if top is None else df.where(F.col(column).between(lowest, top))


def term_matrix(
    counts: DataFrame, vocabulary: DataFrame, rows: DataFrame, key: str = "user_id", column: str = "token",
    value: str = "frequency",
) -> DataFrame:
    """``(row_id, token_id, value)`` from (key, token, count) rows.

    The joins come first: they leave the wanted columns and rows only, so the
    one exchange for the sums carries just the cells of the matrix.
    """
    return (
        counts.select(key, column, value)
        .join(vocabulary.select(column, "token_id"), column)
        .join(rows.select(key, "row_id"), key)
        .groupBy("row_id", "token_id").agg(F.sum(value).alias("value"))
    )


def document_term_matrix(
    df: DataFrame, tokens: Column | Callable[[Column], Column], vocabulary: DataFrame, rows: DataFrame,
    key: str = "user_id", text: str | None = None,
) -> DataFrame:
    """Token counts of the known rows; several texts of one key add up.

    With ``text``, ``tokens`` is a function, as in ``daily.token_frequency``,
    and the texts of a key are brought together.
    """
    if text is not None:
        return term_matrix(daily.user_token_frequency(df, tokens, [key], text), vocabulary, rows, key)
    return term_matrix(daily.token_frequency(df, tokens, [key]), vocabulary, rows, key)


def adjacency(edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node ids and matrix of one interaction layer.

    Dataset users keep their row id; accounts they only point at get the ids
    that follow, in id order.  Returns ``(id, node_id)`` and
    ``(row_id, node_id, value)``.
    """
    known = rows.select(F.col("user_id").alias("id"), "row_id")
    out = edges.join(known.select(F.col("id").alias("src"), "row_id"), "src")
    outside = out.select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
    nodes = known.select("id", F.lit(0).alias("_outside"), "row_id").unionByName(
        outside.select("id", F.lit(1).alias("_outside"), F.col("id").alias("row_id"))
    )
    ids = number_rows(nodes, [F.col("_outside"), F.col("row_id")], "node_id").select("id", "node_id")
    matrix = out.join(ids.select(F.col("id").alias("dst"), "node_id"), "dst").select(
        "row_id", "node_id", F.col("weight").alias("value")
    )
    return ids, matrix


def domain_vocabulary(user_domains: DataFrame, min_frequency: int = 1) -> DataFrame:
    totals = user_domains.groupBy("domain").agg(F.sum("frequency").alias("frequency"))
    return with_token_ids(totals.where(F.col("frequency") >= min_frequency), "domain")


def profile_domains(profiles: DataFrame) -> DataFrame:
    """Main domain and top-level label of each profile link."""
    host = U.domain(F.col("url"))
    linked = profiles.where(F.coalesce(F.length("url"), F.lit(0)) > 0)
    return linked.select("user_id", U.main_domain(host).alias("main_domain")).withColumn(
        "tld", U.top_level(F.col("main_domain"))
    )


def presence_matrix(items: DataFrame, column: str, min_frequency: int, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary of a profile attribute and its user matrix of ones."""
    counts = items.groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
    vocabulary = with_token_ids(counts.where(F.col("frequency") >= min_frequency), column)
    matrix = (
        items.select("user_id", column).distinct()
        .join(vocabulary.select(column, "token_id"), column)
        .join(rows.select("user_id", "row_id"), "user_id")
        .select("row_id", "token_id", F.lit(1).alias("value"))
    )
    return vocabulary, matrix


def mean_vectors(df: DataFrame, key: str, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of the vectors of each key.

    Elements are averaged as rows, with partial sums in every task, so a key
    with very many vectors is not gathered anywhere.
    """
    cells = df.select(key, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_p"))
    return packed.select(key, F.transform("_p", lambda p: p["x"]).alias(vector))


def encode_texts(df: DataFrame, make_encoder, text: str = "text", name: str = "embedding") -> DataFrame:
    """Vectors of texts by any model, in Arrow batches.

    ``make_encoder`` is called once per task and returns a function from a list
    of texts to a list of vectors.
    """
    schema = df.drop(text).withColumn(name, F.array().cast("array<double>")).schema

    def encode(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            vectors = encoder(batch[text].tolist())
            yield batch.drop(columns=[text]).assign(**{name: [list(map(float, v)) for v in vectors]})

    return df.mapInPandas(encode, schema)


def user_embeddings(posts: DataFrame, make_encoder, rows: DataFrame, text: str = "text") -> DataFrame:
    """Mean post vector per user, aligned to row ids."""
    encoded = encode_texts(posts.select("user_id", text), make_encoder, text)
    return mean_vectors(encoded, "user_id", "embedding").join(rows.select("user_id", "row_id"), "user_id")


def features_with_names(matrix: DataFrame, vocabulary: DataFrame, family: str, key: str = "token",
                        id_column: str = "token_id") -> DataFrame:
    """Matrix entries with the family and name of their column."""
    names = vocabulary.select(F.col(id_column).alias("token_id"), F.col(key).cast("string").alias("token"))
    cells = matrix.withColumnRenamed(id_column, "token_id") if id_column != "token_id" else matrix
    return cells.join(names, "token_id").withColumn("type", F.lit(family))
