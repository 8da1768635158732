"""Positions and selections over ordered rows, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from agorasift.operators.durable import durable, stored

_SLICE_BITS = 33  # layout of monotonically_increasing_id: slice above, row below


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str = "row_id", within: Sequence[str] = (), start: int = 0
) -> DataFrame:
    """Dense position of each row by ``order``, overall or inside each group.

    The order must be total.  Rows are range-sorted over all tasks, numbered
    inside their slice, and shifted by the sizes of the slices before; only one
    small row per slice (and group) takes part in a running sum.  A group that
    holds most of the rows is spread over many slices.  The slice numbers are
    stored before use, so a recomputed task cannot move them.
    """
    within = list(within)
    keys = [F.col(c).asc() for c in within] + list(order)
    placed = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_slice", F.shiftright("_at", _SLICE_BITS)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1))
    )
    sizes = placed.groupBy(*within, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *within, "_slice", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    # null-safe, so that rows of the null group keep their place
    shifts = shifts.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(within)], F.col("_slice").alias("_in"), "_shift")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(within)], F.col("_slice") == F.col("_in"))
    position = F.col("_at") + F.col("_shift") + F.lit(start)
    return placed.join(shifts, same).select(*df.columns, position.cast("long").alias(name))


def top_rows(df: DataFrame, k: int, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows by ``order``, overall or per group (a report feature).

    Both forms keep at most ``k`` rows per task before any exchange.
    """
    if not within:
        return df.orderBy(*order).limit(k)
    window = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def hash_order(*columns: str | Column, seed: int = 42) -> Column:
    """Reproducible pseudo-random order key."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``.

    An aggregate, so a key with very many rows is reduced before the exchange.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    choose = F.max_by if last else F.min_by
    packed = df.groupBy(*keys).agg(choose(F.struct(*rest), rank).alias("_row"))
    return packed.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def distinct_level_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """Linear-interpolation quantile, taken over (value, count) pairs.

    Equal values are counted first; the levels are range-sorted over all tasks
    and get running totals slice by slice, so no task holds all of them.  Only
    the one or two levels at the wanted position reach the driver.
    """
    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    levels = durable(levels.repartitionByRange("_level").sortWithinPartitions("_level").withColumn(
        "_slice", F.shiftright(F.monotonically_increasing_id(), _SLICE_BITS)))
    sizes = levels.groupBy("_slice").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    total = levels.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    place = share * (total - 1)
    inside = Window.partitionBy("_slice").orderBy("_level")
    ends = F.sum("_n").over(inside) + F.col("_before")
    found = levels.join(sizes, "_slice").select("_level", (ends - F.col("_n")).alias("_first"), ends.alias("_end"))
    low, high = floor(place), min(floor(place) + 1, total - 1)
    rows = found.where((F.col("_first") <= high) & (F.col("_end") > low)).collect()
    value = lambda at: next(float(r["_level"]) for r in rows if r["_first"] <= at < r["_end"])
    return value(low) + (place - low) * (value(high) - value(low))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per group: (group, share, value).

    Values are ranked over all tasks, so a group of any size is never held in
    one place; only the rows next to each position are kept.
    """
    within = list(within)
    rows = df.select(*within, F.col(column).cast("double").alias("value")).where(F.col("value").isNotNull())
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranked = durable(number_rows(rows, [F.col("value"), F.col("_tie")], "_at", within=within))
    keys = within or ["_all"]
    ranked = ranked if within else ranked.withColumn("_all", F.lit(0))
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.select(*keys, F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), "_n")
    place = F.col("share") * (F.col("_n") - 1)
    wanted = wanted.select(*keys, "share", F.explode(F.array(
        F.struct(F.floor(place).alias("_at"), (1 - (place - F.floor(place))).alias("_w")),
        F.struct((F.floor(place) + 1).alias("_at"), (place - F.floor(place)).alias("_w")),
    )).alias("p")).select(*keys, "share", "p.*").where(F.col("_w") > 0)
    return wanted.join(ranked, [*keys, "_at"]).groupBy(*keys, "share").agg(
        F.sum(F.col("value") * F.col("_w")).alias("value")).select(*within, "share", "value")
