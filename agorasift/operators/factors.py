"""Non-negative factors of a long matrix, by alternating least squares on a fixed grid of blocks.

Rows and columns are hashed to the blocks of a grid once, and the cells of a
grid block stay together.  A half-round multiplies every grid block with the
factor it needs, adds the products up by block of the other factor, and solves
there, row by row, the least squares under x >= 0.  Only the k x k products of
a factor with itself reach the driver.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from agorasift.operators.durable import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

LOG = logging.getLogger(__name__)
GRID_CELLS, BLOCK_ROWS = 1 << 20, 1 << 16  # cells of a grid block, rows of a factor's block, about
SWEEPS = 12  # over the k unknowns of a row, each half-round; they start from the round before
ALONE_SWEEPS = 400  # where nothing follows
LEAST_ROUNDS, ROUNDS_BETWEEN, MOST_ROUNDS = 5, 3, 500


def least_squares(products: np.ndarray, gram: np.ndarray, start: np.ndarray, sweeps: int) -> np.ndarray:
    """Rows x >= 0 with the least |a - x F|, from a F' and F F', by turns over the unknowns."""
    x = start.copy()
    for _ in range(sweeps):
        before = x.copy()
        for j in range(len(gram)):
            if gram[j, j] > 0:
                x[:, j] = np.maximum(0.0, x[:, j] + (products[:, j] - x @ gram[:, j]) / gram[j, j])
            else:
                x[:, j] = 0.0
        if np.array_equal(before, x):
            break
    return x


def _product(at: np.ndarray, other: np.ndarray, value: np.ndarray, factor: np.ndarray, size: int) -> np.ndarray:
    """Sum of value times the factor's row ``other`` by ``at``."""
    return np.stack([np.bincount(at, value * factor[other, j], size) for j in range(factor.shape[1])], axis=1)


def settled(errors: list[float], tolerance: float) -> bool:
    """Whether the last rounds lowered the error by no more than ``tolerance`` of the matrix's own norm, the first entry."""
    rounds = len(errors) - 1
    if errors[0] == 0 or rounds >= MOST_ROUNDS:
        return True
    return rounds >= LEAST_ROUNDS and errors[-1 - ROUNDS_BETWEEN] - errors[-1] <= tolerance * errors[0]


def _error(squares: float, fitted: float, gram: np.ndarray, other: np.ndarray) -> float:
    return max(squares - 2 * fitted + float((gram * other).sum()), 0.0) ** 0.5


def factorise(row: np.ndarray, column: np.ndarray, value: np.ndarray, w: np.ndarray, columns: int, tolerance: float
              ) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Both factors of one block, and the errors of the rounds."""
    squares = float((value * value).sum())
    h, errors = np.zeros((columns, w.shape[1])), [squares ** 0.5]
    while not settled(errors, tolerance):
        gram = w.T @ w
        h = least_squares(_product(column, row, value, w, columns), gram, h, SWEEPS)
        products, gram = _product(row, column, value, h, len(w)), h.T @ h
        w = least_squares(products, gram, w, SWEEPS)
        errors.append(_error(squares, float((products * w).sum()), w.T @ w, gram))
    return w, h, errors


def _numbered(ids: DataFrame, key: str, blocks: int, name: str, k: int, seed: int) -> DataFrame:
    """(key, block, at, start): the place of a key in its block, and start values that depend on the key only."""
    unit = [((F.pmod(F.xxhash64(key, F.lit(i), F.lit(name), F.lit(seed)), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20))) for i in range(k)]
    placed = ids.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(blocks)).cast("long"))
    return placed.select(key, "block", (F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1).alias("at"), F.array(*unit).alias("start"))


def _bytes_of(schema: str, build: Callable[[pa.Table], dict]) -> tuple[Callable[[pa.Table], pa.Table], str]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(n, kinds[t]) for n, t in fields])

    def made(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([build(rows)], arrow)

    return made, schema


def _packed(cells: DataFrame) -> DataFrame:
    """(rb, cb, row, column, value) of each grid block, as bytes."""
    def build(rows: pa.Table) -> dict:
        arrays = {n: rows.column(n).to_numpy() for n in ("ri", "ci", "value")}
        order = np.lexsort((arrays["ci"], arrays["ri"]))
        return {"rb": rows.column("rb")[0].as_py(), "cb": rows.column("cb")[0].as_py(), "ri": arrays["ri"][order].astype(np.int32).tobytes(),
                "ci": arrays["ci"][order].astype(np.int32).tobytes(), "value": arrays["value"][order].astype(float).tobytes()}

    return cells.groupBy("rb", "cb").applyInArrow(*_bytes_of("rb long, cb long, ri binary, ci binary, value binary", build))


def _first_factor(index: DataFrame) -> DataFrame:
    """(block, factor, gram, fitted) of the start values."""
    def build(rows: pa.Table) -> dict:
        rows = rows.sort_by("at")
        factor = np.array(rows.column("start").to_pylist(), float)
        return {"block": rows.column("block")[0].as_py(), "factor": factor.tobytes(), "gram": (factor.T @ factor).tobytes(), "fitted": 0.0}

    return index.select("block", "at", "start").groupBy("block").applyInArrow(*_bytes_of(_FACTOR, build))


_FACTOR = "block long, factor binary, gram binary, fitted double"


def _gram(factor: DataFrame, k: int) -> tuple[np.ndarray, float]:
    rows = factor.select("block", "gram", "fitted").collect()  # k x k numbers of each block
    rows.sort(key=lambda r: r["block"])
    return sum(np.frombuffer(r["gram"]).reshape(k, k) for r in rows), sum(r["fitted"] for r in rows)


def _half_round(grid: DataFrame, known: DataFrame, gram: np.ndarray, last: DataFrame, near: str, far: str, k: int) -> DataFrame:
    """The factor of ``far`` blocks from that of ``near`` blocks; ``last`` is the one of the round before."""
    at, other = ("ci", "ri") if far == "cb" else ("ri", "ci")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.LongType()), T.StructField("factor", T.BinaryType())])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, columns, value = np.frombuffer(r[at], np.int32), np.frombuffer(r[other], np.int32), np.frombuffer(r["value"])
                product = _product(rows, columns, value, np.frombuffer(r["factor"]).reshape(-1, k), int(rows.max()) + 1)
                yield pa.RecordBatch.from_pylist([{"block": r[far], "part": r[near], "factor": product.tobytes()}],
                                                 pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema]))

    def solve(rows: pa.Table) -> dict:
        parts = sorted(rows.to_pylist(), key=lambda r: r["part"])  # part -1: the start
        start = np.frombuffer(parts[0]["factor"]).reshape(-1, k)
        products = np.zeros_like(start)
        for r in parts[1:]:
            part = np.frombuffer(r["factor"]).reshape(-1, k)
            products[: len(part)] += part
        factor = least_squares(products, gram, start, SWEEPS)
        return {"block": parts[0]["block"], "factor": factor.tobytes(), "gram": (factor.T @ factor).tobytes(),
                "fitted": float((factor * products).sum())}

    met = grid.join(known.select(F.col("block").alias(near), "factor"), near).select("rb", "cb", "ri", "ci", "value", "factor")
    parts = met.mapInArrow(multiply, schema).unionByName(last.select("block", F.lit(-1).cast("long").alias("part"), "factor"))
    return durable(parts.groupBy("block").applyInArrow(*_bytes_of(_FACTOR, solve)))


def _rows_of(factor: DataFrame, index: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """(key, name0..) of a factor held in blocks."""
    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = np.frombuffer(r["factor"]).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), r["block"])), pa.array(np.arange(len(values), dtype=np.int32)),
                                                  *[pa.array(values[:, i]) for i in range(k)]], ["block", "at", *[f"{name}{i}" for i in range(k)]])

    rows = factor.select("block", "factor").mapInArrow(unpack, "block long, at int, " + ", ".join(f"{name}{i} double" for i in range(k)))
    return index.select(key, "block", "at").join(rows, ["block", "at"]).select(key, *[f"{name}{i}" for i in range(k)])


def _alone(k: int, tolerance: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                arrays = [np.frombuffer(r[n], kind) for n, kind in (("ri", np.int32), ("ci", np.int32), ("value", float))]
                w, h, errors = factorise(*arrays, np.frombuffer(r["factor"]).reshape(-1, k), int(arrays[1].max()) + 1, tolerance)
                yield pa.RecordBatch.from_pylist([{"w": w.tobytes(), "h": h.tobytes(), "rounds": len(errors) - 1, "error": errors[-1] / errors[0]}],
                                                 pa.schema([("w", pa.binary()), ("h", pa.binary()), ("rounds", pa.int64()), ("error", pa.float64())]))

    return work


def fit_nmf(cells: DataFrame, k: int, tolerance: float = 1e-4, seed: int = 42, row: str = "row_id", column: str = "token_id",
            grid_cells: int = GRID_CELLS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Row and column factors ``(row, w0..)`` and ``(column, h0..)`` of cells (row, column, value).

    Rounds go on until the last three lowered the error by no more than
    ``tolerance`` of the matrix's own norm.  A matrix whose cells fit one grid block
    is factorised in the task that has it; a larger one takes two
    exchanges a half-round, of products and factors, never of cells.  Cells of
    zero and null are left out; an empty matrix gives empty factors.
    """
    cells = durable(cells.where("value <> 0").select(row, column, F.col("value").cast("double").alias("value")))
    squares, counted = cells.agg(F.sum(F.col("value") * F.col("value")), F.count(F.lit(1))).first()
    if not counted:
        empty = lambda key, name: cells.select(key, *[F.lit(0.0).alias(f"{name}{i}") for i in range(k)]).limit(0)
        return empty(row, "w"), empty(column, "h")
    ids = {key: cells.select(key).distinct() for key in (row, column)}
    side = int(np.ceil((counted / grid_cells) ** 0.5))
    blocks = {key: max(side, -(-ids[key].count() // block_rows)) for key in ids}
    rows = durable(_numbered(ids[row], row, blocks[row], "w", k, seed))
    columns = durable(_numbered(ids[column], column, blocks[column], "h", k, seed))
    placed = cells.join(rows.select(row, F.col("block").alias("rb"), F.col("at").alias("ri")), row).join(
        columns.select(column, F.col("block").alias("cb"), F.col("at").alias("ci")), column)
    grid, w = durable(_packed(placed.select("rb", "cb", "ri", "ci", "value"))), durable(_first_factor(rows))
    if blocks[row] == blocks[column] == 1:
        held = grid.join(w.select(F.col("block").alias("rb"), "factor"), "rb").select("ri", "ci", "value", "factor")
        found = durable(held.mapInArrow(_alone(k, tolerance), "w binary, h binary, rounds long, error double"))
        told = found.select("rounds", "error").first()
        LOG.info("NMF: %d rounds, error %.6g of the norm", told["rounds"], told["error"])
        of = lambda name: found.select(F.lit(0).cast("long").alias("block"), F.col(name).alias("factor"))
        return _rows_of(of("w"), rows, row, "w", k), _rows_of(of("h"), columns, column, "h", k)
    kept = {side: grid.repartition(side).persist(StorageLevel.MEMORY_AND_DISK) for side in ("rb", "cb")}
    h = durable(_first_factor(columns.withColumn("start", F.array_repeat(F.lit(0.0), k))))
    gram, errors = _gram(w, k)[0], [squares ** 0.5]
    while not settled(errors, tolerance):
        h = _half_round(kept["rb"], w, gram, h, "rb", "cb", k)
        other = _gram(h, k)[0]
        w = _half_round(kept["cb"], h, other, w, "cb", "rb", k)
        gram, fitted = _gram(w, k)
        errors.append(_error(squares, fitted, gram, other))
    for side in kept.values():
        side.unpersist()
    LOG.info("NMF: %d rounds, error %.6g of the norm", len(errors) - 1, errors[-1] / errors[0])
    return _rows_of(w, rows, row, "w", k), _rows_of(h, columns, column, "h", k)


def nmf_transform(cells: DataFrame, h: DataFrame, k: int, row: str = "row_id", column: str = "token_id") -> DataFrame:
    """Row factor of other rows with the column factor kept: products by one join, then least squares row by row."""
    grams = [F.sum(F.col(f"h{i}") * F.col(f"h{j}")) for i in range(k) for j in range(k)]
    gram = np.array([v or 0.0 for v in h.agg(*grams).first()], float).reshape(k, k)
    products = cells.select(row, column, "value").join(h, column).groupBy(row).agg(
        *[F.sum(F.col("value") * F.col(f"h{i}")).alias(f"w{i}") for i in range(k)])
    names = [f"w{i}" for i in range(k)]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            x = least_squares(of, gram, np.zeros_like(of), ALONE_SWEEPS)
            yield pa.RecordBatch.from_arrays([batch.column(row), *[pa.array(x[:, i]) for i in range(k)]], [row, *names])

    return products.mapInArrow(solve, products.schema)
