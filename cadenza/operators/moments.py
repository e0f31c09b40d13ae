"""Counts, means and centred co-moments of vectors, merged without the cancellation of raw sums.

A task centres each Arrow batch on its own mean and merges the batches' co-moments pairwise; tasks' are merged the same way, a
few at a time. What leaves the executors is d * (d + 1) / 2 numbers, whatever the number of rows, and constants have
co-moments of exactly 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "part int, n long, mean array<double>, m array<double>"


@dataclass
class Moments:
    """n vectors, their mean and the sum of the products of their deviations from it."""

    n: int
    mean: np.ndarray
    m: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Of the rows of a matrix."""
        shift = x[0]
        x = x - shift  # equal rows are exactly 0
        mean = x.mean(0)
        x = x - mean
        return Moments(len(x), shift + mean, x.T @ x)

    def merged(self, other: Moments) -> Moments:
        if len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} elements")
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.m + other.m + np.outer(apart, apart) * (self.n * (other.n / n)))

    @property
    def cov(self) -> np.ndarray:
        """The population covariance."""
        return self.m / self.n


def matrix(rows: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as rows; they must be of one length."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} elements")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def whole(vectors: DataFrame, column: str) -> DataFrame:
    """(v array<double>): the column's vectors without null and empty ones and such with null elements."""
    v = F.col("v")
    return vectors.select(F.col(column).cast("array<double>").alias("v")).where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (F.size(v) > 0))


def _row(state: Moments | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if state is not None:
        upper = state.m[np.triu_indices(len(state.mean))]
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (state.mean, upper)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([state.n], pa.int64()), *lists], names=["part", "n", "mean", "m"])


def _state(n: int, mean: np.ndarray, upper: np.ndarray) -> Moments:
    d = len(mean)
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = upper
    return Moments(n, mean, m + np.triu(m, 1).T)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        if batch.num_rows:
            own = Moments.of(matrix(batch.column(0)))
            state = own if state is None else state.merged(own)
    yield from _row(state)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        for k in range(batch.num_rows):
            mean, upper = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
            own = _state(batch.column(1)[k].as_py(), mean, upper)
            state = own if state is None else state.merged(own)
    yield from _row(state)


def moment_row(vectors: DataFrame, column: str) -> DataFrame:
    """(part, n, mean, m): one row with the moments of an array column, m the upper triangle by rows; no row for no vectors.

    Null and empty vectors and such with null elements are left out; vectors of several lengths raise a ValueError.
    """
    parts = whole(vectors, column)
    tasks = parts.rdd.getNumPartitions()
    parts = parts.mapInArrow(_taken, STATE)
    for width in ([math.isqrt(tasks)] if tasks > 16 else []) + [1]:
        parts = parts.repartition(width, F.pmod("part", F.lit(width))).mapInArrow(_added, STATE)
    return parts


def moments(vectors: DataFrame, column: str) -> Moments | None:
    """The moments of an array column, on the driver; None for no vectors."""
    row = moment_row(vectors, column).first()
    return None if row is None else _state(row.n, np.array(row["mean"]), np.array(row.m))


def pearson(vectors: DataFrame, column: str) -> DataFrame:
    """(a, b, r) of all pairs of elements a < b of an array column; null where an element is constant."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                state = _state(1, *(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3)))
                a, b = np.triu_indices(len(state.mean), 1)
                spread = np.sqrt(np.diag(state.m))
                both = spread[a] * spread[b]
                r = np.divide(state.m[a, b], both, out=np.zeros(len(a)), where=both > 0)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(r, mask=both == 0)], names=["a", "b", "r"])

    return moment_row(vectors, column).mapInArrow(pairs, "a long, b long, r double")
