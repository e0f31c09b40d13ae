"""Passes over rows that add up arrays: what gradient methods need of Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import matrix


def labelled(rows: DataFrame, key: str, label: str, column: str, part: Column) -> DataFrame:
    """(label, v array<double>, part int) of the rows that can be trained on: no null label, key, vector or element."""
    v = F.col(column).cast("array<double>")
    whole = F.col(label).isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    return rows.where(whole).select(F.col(label).alias("label"), v.alias("v"), part.cast("int").alias("part"))


def by_hash(key: str, parts: int, seed: int) -> Column:
    """A number from 0 to parts - 1 that the key's hash draws."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts))


def summed(rows: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, pa.Array, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows (label, v, part): add(total, labels, matrix, parts) adds a batch to a task's total.

    A task gives out one array; those of many tasks are added up by fewer before they come to the driver, so it gets few of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, met = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                add(total, batch.column(0), matrix(batch.column(1)), batch.column(2).to_numpy())
                met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, 0
        for batch in batches:
            for task, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(data, np.float64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    tasks = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(run, "task int, total binary")
    if tasks > 16:
        width = math.isqrt(tasks)
        found = found.repartition(width, F.pmod("task", F.lit(width))).mapInArrow(more, "task int, total binary")
    out = np.zeros(math.prod(shape))
    for row in sorted(found.collect(), key=lambda r: r.task):
        out = out + np.frombuffer(row.total, np.float64)
    return out.reshape(shape)


def places(labels: pa.Array, classes: list) -> np.ndarray:
    """Each label's place among the classes."""
    at = {c: k for k, c in enumerate(classes)}
    return np.array([at[x] for x in labels.to_pylist()], int)
