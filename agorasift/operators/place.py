"""Posts by place: point-in-region joins, place terms, emotions over space and time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from agorasift.functions import geo
from agorasift.functions import text as T
from agorasift.operators.daily import MOST_TESTED, listed_pieces
from agorasift.operators.durable import stored
from agorasift.operators.labels import inverse_frequency, tfidf
from agorasift.operators.pieces import listed_piece_counts
from agorasift.operators.ranking import exact_quantiles, top_rows

EMOTIONS = ("anger", "fear", "joy", "sadness")


def daily_counts(posts: DataFrame, start: str, end: str, by: str = "date") -> DataFrame:
    """Posts per day from ``start`` to ``end``, days without posts as 0."""
    days = posts.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(by))
    counts = posts.groupBy(by).agg(F.count(F.lit(1)).alias("n_posts"))
    return days.join(counts, by, "left").na.fill(0, ["n_posts"])


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def _region_cells(regions: DataFrame, size: float) -> DataFrame:
    """Each region once per grid cell that its bounding box touches."""
    rows = F.explode(F.sequence(_cell(F.col("lat0"), size), _cell(F.col("lat1"), size))).alias("_row")
    columns = F.explode(F.sequence(_cell(F.col("lon0"), size), _cell(F.col("lon1"), size))).alias("_column")
    return regions.select("*", rows).select("*", columns)


def join_boxes(points: DataFrame, boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """Points with the name of the box around them.

    An equi-join on grid cells, then the exact test: the work per point depends
    on the regions near it and not on all of them.
    """
    placed = points.withColumns({"_row": _cell(F.col("lat"), size), "_column": _cell(F.col("lon"), size)})
    near = placed.join(_region_cells(boxes, size), ["_row", "_column"])
    inside = geo.in_box(*[F.col(c) for c in ("lat", "lon", "lat0", "lat1", "lon0", "lon1")])
    return near.where(inside).select(*points.columns, "name")


def join_polygons(points: DataFrame, polygons: DataFrame, size: float = 10.0) -> DataFrame:
    """Points with the name of the polygon around them.

    ``polygons`` holds (name, ring) with ``ring`` an array of struct(x = lon,
    y = lat).
    """
    boxed = polygons.withColumns({
        "lat0": F.array_min(F.transform("ring", lambda v: v["y"])), "lat1": F.array_max(F.transform("ring", lambda v: v["y"])),
        "lon0": F.array_min(F.transform("ring", lambda v: v["x"])), "lon1": F.array_max(F.transform("ring", lambda v: v["x"])),
    })
    placed = points.withColumns({"_row": _cell(F.col("lat"), size), "_column": _cell(F.col("lon"), size)})
    near = placed.join(_region_cells(boxed, size), ["_row", "_column"]).where(
        F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1")))
    return near.where(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("ring"))).select(*points.columns, "name")


def place_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("name").agg(F.count(F.lit(1)).alias("n_posts")).orderBy(F.desc("n_posts"), "name")


def bbox_clip(points: DataFrame, south: float, north: float, west: float, east: float, buffer: float = 0.0) -> DataFrame:
    """Points inside a box widened by a buffer, edges included."""
    return points.where(F.col("lat").between(south - buffer, north + buffer) & F.col("lon").between(west - buffer, east + buffer))


def term_importance(weighted: DataFrame, column: str = "token") -> DataFrame:
    """Column sums of a weighted matrix."""
    return weighted.groupBy(column).agg(F.sum("value").alias("importance"))


def place_terms(cells: DataFrame, places: DataFrame, rows: int, row: str = "row_id", column: str = "token") -> DataFrame:
    """Place-by-term tf-idf; term weights come from the single posts."""
    idf = inverse_frequency(cells, rows, row, column)
    sums = cells.join(places.select(row, "name"), row).groupBy("name", column).agg(F.sum("value").alias("value"))
    return tfidf(sums, norm="l2", row="name", column=column, idf=idf)


def place_top_terms(weighted: DataFrame, k: int = 10, column: str = "token") -> DataFrame:
    return top_rows(weighted, k, [F.desc("value"), F.asc(column)], within=["name"])


def emotion_scores(posts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text",
                   labels: Sequence[str] = EMOTIONS) -> DataFrame:
    """Softmax of the lexicon weights found in each post; no hits give equal shares.

    ``lexicon`` is the small table (token, label, weight).  Handles and tokens
    end at spaces, so only pieces between spaces are tokenised: with up to
    ``MOST_TESTED`` tokens those that may hold one, in one reading of the
    texts; with more the distinct ones, in two.
    """
    tokens = lambda piece: T.tokenize(T.mask_handles(piece))
    weight = F.col("weight") * F.col("_n")
    sums = lambda of: [F.sum(F.when(F.col("label") == c, of).otherwise(0.0)).alias(f"_{c}") for c in labels]
    listed = [row[0] for row in lexicon.where(F.length("token") > 0).select("token").distinct().limit(MOST_TESTED + 1).collect()]
    if len(listed) <= MOST_TESTED:
        pieces = listed_piece_counts(posts, [key], text, listed)
        # outer, or Spark tokenises each piece once more to see whether it has any tokens
        words = pieces.select(key, F.explode_outer(tokens(F.col("_piece"))).alias("token"), "_n")
        found = words.where(F.col("token").isin(listed)).join(lexicon, "token").groupBy(key).agg(*sums(weight))
    else:
        pieces = listed_pieces(posts, tokens, lexicon, text)
        pieces = stored(pieces.join(lexicon, "token").groupBy("_piece").agg(*sums(weight)), "weights")
        words = posts.select(key, F.explode(F.split(text, " ")).alias("_piece")).join(pieces, "_piece")
        found = words.groupBy(key).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in labels])
    scored = posts.drop(text).join(found, key, "left").na.fill(0.0, [f"_{c}" for c in labels])
    top = F.greatest(*[F.col(f"_{c}") for c in labels])
    scored = scored.withColumns({f"_{c}": F.exp(F.col(f"_{c}") - top) for c in labels})
    total = sum(F.col(f"_{c}") for c in labels)
    return scored.withColumns({c: F.col(f"_{c}") / total for c in labels}).drop(*[f"_{c}" for c in labels])


def score_texts(posts: DataFrame, make_scorer, labels: Sequence[str] = EMOTIONS, text: str = "text") -> DataFrame:
    """Class scores of texts by any model, in Arrow batches.

    ``make_scorer`` is called once per task and returns a function from a list
    of texts to one row of scores per text.
    """
    schema = posts.drop(text).withColumns({c: F.lit(0.0) for c in labels}).schema

    def score(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            values = pd.DataFrame(scorer(batch[text].tolist()), columns=list(labels), index=batch.index)
            yield pd.concat([batch.drop(columns=[text]), values.astype(float)], axis=1)

    return posts.withColumn(text, T.mask_handles(F.col(text))).mapInPandas(score, schema)


def place_emotion(scored: DataFrame, labels: Sequence[str] = EMOTIONS) -> DataFrame:
    """Median of each emotion per place: (name, label, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("score")) for c in labels])
    long = scored.select("name", F.explode(cells).alias("c")).select("name", "c.*")
    return exact_quantiles(long, "score", [0.5], within=["name", "label"]).drop("share")


def daily_emotion(scored: DataFrame, labels: Sequence[str] = EMOTIONS, by: str = "date") -> DataFrame:
    return scored.groupBy(by).agg(*[F.avg(c).alias(c) for c in labels])


def place_cosine(profiles: DataFrame) -> DataFrame:
    """Cosine similarity of every two places from (name, topic, share) rows.

    The result has one row per two places with a topic in common, by
    definition.  Places come from a list of regions and do not grow with the
    posts.  Products are summed inside tasks before the exchange.
    """
    lengths = profiles.groupBy("name").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("_length"))
    unit = profiles.join(lengths, "name").where(F.col("_length") > 0).select("name", "topic", (F.col("share") / F.col("_length")).alias("x"))
    other = unit.select(F.col("name").alias("other"), "topic", F.col("x").alias("y"))
    return unit.join(other, "topic").groupBy("name", "other").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
