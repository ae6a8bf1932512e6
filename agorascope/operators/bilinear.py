"""Affinity of sentences and entities: a bilinear form x' W e, fitted to given values by conjugate gradients.

The least squares problem over W has d times m unknowns, and its matrix d m squared numbers. Of few unknowns it is summed up in
one pass over the rows, otherwise it is never built: what conjugate gradients need of it is its product with a given V, the sum over all rows of x (x' V e) e', plus ridge V: one
pass over the rows, in which each task sums its part and Spark sums the tasks' rows. V is sent to the tasks (its size is
checked); the driver holds four matrices of that size. In exact arithmetic as many passes as unknowns are enough; it stops
when the residual has fallen to ``tolerance`` of the start.

Both sides may get a further entry 1, which adds a linear form of each side and a constant. Rows with a null or a vector of
another length are an error; without rows W is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import Steps


#: A matrix of so many numbers is summed up, by each task first.
GRAM = 1_000_000


@dataclass
class Form:
    weights: np.ndarray
    ones: bool
    passes: int


def _matrix(column: pa.Array, width: int, ones: bool) -> np.ndarray:
    if column.null_count or (len(column) and set(np.diff(column.offsets.to_numpy())) != {width}):
        raise ValueError(f"vectors of {width} numbers are needed")
    x = column.flatten().to_numpy().reshape(len(column), width)
    return np.hstack([x, np.ones((len(x), 1))]) if ones else x


def _summed(rows: DataFrame, d: int, m: int, ones: bool, shape: tuple[int, int], of) -> np.ndarray:
    """The sum over all rows of the matrices of ``shape`` that ``of`` makes in the tasks of some rows' (x, e, y)."""
    height = shape[0]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for whole in batches:
            for s in range(0, whole.num_rows, 2_000):
                batch = whole.slice(s, 2_000)
                total += of(_matrix(batch.column(0), d, ones), _matrix(batch.column(1), m, ones), batch.column(2).to_numpy(zero_copy_only=False))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array([task] * height, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "task", "row"])

    def together(tasks: pa.Table) -> pa.Table:
        tasks = tasks.sort_by("task")  # the same order each time
        total = np.sum(np.array(tasks["row"].to_pylist()), 0)
        return pa.table({"i": tasks["i"].slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    found = rows.select("x", "e", "y").mapInArrow(part, "i int, task int, row array<double>").groupBy("i").applyInArrow(together, "i int, row array<double>")
    out = np.zeros(shape)
    for r in found.collect():  # a row for each of the matrix
        out[r["i"]] = r["row"]
    return out


def _system(x: np.ndarray, e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rows' part of the problem's matrix, and of its right side as a last column."""
    z = (x[:, :, None] * e[:, None, :]).reshape(len(x), -1)
    return z.T @ np.hstack([z, y[:, None]])


def shares(rows: DataFrame, column: str, width: int) -> DataFrame:
    """Rows with each list of numbers below ``width`` replaced by how often it holds each of them, as shares of its length."""
    at = rows.columns.index(column)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = np.diff(batch.column(at).offsets.to_numpy()), batch.column(at).flatten().to_numpy()
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * width + values, minlength=len(sizes) * width).reshape(len(sizes), width)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * width, pa.int32()), pa.array((n / np.maximum(sizes, 1)[:, None]).ravel()))
            yield pa.RecordBatch.from_arrays([x if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    fields = [T.StructField(column, T.ArrayType(T.DoubleType())) if f.name == column else f for f in rows.schema.fields]
    return rows.mapInArrow(counted, T.StructType(fields))


def fit(rows: DataFrame, d: int, m: int, ridge: float = 1e-3, ones: bool = True, tolerance: float = 1e-10, most: int = 4_000_000, passes: int | None = None) -> Form:
    """W for rows (x array<double> of d, e array<double> of m, y double): least sum of (x' W e - y)^2 + ridge |W|^2."""
    size = (d + ones) * (m + ones)
    if size > most:
        raise ValueError(f"more than {most} unknowns to send to every task")
    rows = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("e").cast("array<double>").alias("e"), F.col("y").cast("double").alias("y"))
    w = np.zeros((d + ones, m + ones))
    if size * (size + 1) <= GRAM:
        system = _summed(rows, d, m, ones, (size, size + 1), _system)
        residual = system[:, -1].reshape(w.shape).copy()
        times = lambda v: (system[:, :-1] @ v.ravel()).reshape(w.shape)
    else:
        rows = Steps(rows.sparkSession, "bilinear").save(rows)
        residual = _summed(rows, d, m, ones, w.shape, lambda x, e, y: (x * y[:, None]).T @ e)
        times = lambda v: _summed(rows, d, m, ones, w.shape, lambda x, e, y: (x * ((x @ v) * e).sum(1)[:, None]).T @ e)
    way, gap, n = residual.copy(), float(np.square(residual).sum()), 0
    least = tolerance**2 * gap
    while gap > least and n < (passes or 2 * size):
        product = times(way) + ridge * way
        step = gap / float((way * product).sum())
        w, residual = w + step * way, residual - step * product
        after = float(np.square(residual).sum())
        way, gap, n = residual + after / gap * way, after, n + 1
    return Form(w, ones, n)


def scored(rows: DataFrame, form: Form, name: str = "score") -> DataFrame:
    """The rows (x, e, ...) with their values of the form."""
    d, m = form.weights.shape[0] - form.ones, form.weights.shape[1] - form.ones
    rows = rows.withColumns({c: F.col(c).cast("array<double>") for c in ("x", "e")})
    at = [rows.columns.index(c) for c in ("x", "e")]

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, e = (_matrix(batch.column(k), n, form.ones) for k, n in zip(at, (d, m)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(((x @ form.weights) * e).sum(1))], [*batch.schema.names, name])

    return rows.mapInArrow(value, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))
