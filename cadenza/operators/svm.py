"""RBF support vector machines on random Fourier features, with a grid of costs and kernel widths trained in shared passes.

One machine a class against the rest, squared hinge loss: 1/2 |w|^2 + cost * sum(max(0, 1 - y * w z)^2), z the features and a constant 1. All cells of the grid, all folds
and all classes are trained at once by accelerated gradient steps: a pass makes the features once for each width and takes the gradients of all machines as matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix
from .training import by_hash, labelled, places, summed

#: Costs and kernel widths of the full grid: 2^-5 to 2^4.
GRID = [2.0**k for k in range(-5, 5)]


@dataclass
class Svm:
    """Weights (features + 1, classes) of one width."""

    classes: list
    directions: np.ndarray
    shifts: np.ndarray
    gamma: float
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.directions, self.shifts, self.gamma) @ self.weights


@dataclass
class Grid:
    """(cost, gamma, mean accuracy over the folds) of all cells, the best cell, and that cell fitted on all rows; None for no rows."""

    cells: list[tuple[float, float, float | None]]
    best: tuple[float, float] | None
    model: Svm | None


def features(x: np.ndarray, directions: np.ndarray, shifts: np.ndarray, gamma: float) -> np.ndarray:
    """Cosines whose inner products approximate exp(-gamma |x - y|^2), and a constant 1."""
    z = np.cos(x @ directions.T * math.sqrt(2 * gamma) + shifts) * math.sqrt(2 / len(shifts))
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def _trained(data: DataFrame, classes: list, directions: np.ndarray, shifts: np.ndarray, gammas: list[float], costs: list[float], folds: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights (gamma, features + 1, fold, cost, class), rows by fold). Fold k's machines don't see the rows of part k; fold ``folds`` sees all."""
    spark = data.sparkSession
    size, many = len(shifts) + 1, len(classes)
    groups = folds + 1

    def scale(total: np.ndarray, labels: pa.Array, x: np.ndarray, part: np.ndarray) -> None:
        total[-1, 0, :folds] += np.bincount(part, minlength=folds)
        for k, gamma in enumerate(gammas):
            z = features(x, directions, shifts, gamma)
            total[k] += z.T @ z

    first = summed(data, (len(gammas) + 1, size, size), scale)
    rows = first[-1, 0, :folds]
    n = np.append(rows.sum() - rows, rows.sum())
    decay = 1 / np.maximum(np.outer(n, costs), 1e-300)  # (fold, cost)
    # Held-out rows only lower the curvature, so all rows' bounds it.
    steep = np.array([2 * np.linalg.eigvalsh(g)[-1] for g in first[:-1]])[:, None, None] / np.maximum(n, 1)[:, None] + decay
    w = np.zeros((len(gammas), size, groups, len(costs), many))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(ahead)

        def gradient(total: np.ndarray, labels: pa.Array, x: np.ndarray, part: np.ndarray, shared=shared) -> None:
            y = np.where(places(labels, classes)[:, None] == np.arange(many), 1.0, -1.0)[:, None, None, :]
            seen = (part[:, None] != np.arange(groups)).astype(float)[:, :, None, None]
            for k, gamma in enumerate(gammas):
                z = features(x, directions, shifts, gamma)
                score = (z @ shared.value[k].reshape(size, -1)).reshape(len(x), groups, len(costs), many)
                pull = y * np.maximum(0, 1 - y * score) * seen
                total[k] -= 2 * (z.T @ pull.reshape(len(x), -1)).reshape(total[k].shape)

        g = summed(data, w.shape, gradient) / np.maximum(n, 1)[:, None, None] + decay[:, :, None] * ahead
        new = ahead - g / steep[:, None, :, :, None]
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
        shared.unpersist()
    return w, rows


def grid(rows: DataFrame, key: str, label: str, column: str, costs: list[float] = GRID, gammas: list[float] = GRID, folds: int = 3, many: int = 128, rounds: int = 30, seed: int = 1) -> Grid:
    """The accuracy of every cell over folds that the keys' hashes draw, and the best cell, the first of equals by cost and width, fitted on all rows.

    Rows with a null key, label or vector, or a null element, aren't used. Classes are the labels that occur, few of them: a machine for each is held in memory. A fold without rows has no
    accuracy; a table without rows gives cells of None and no model.
    """
    data = labelled(rows, key, label, column, by_hash(key, folds, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = [r.label for r in data.select("label").distinct().orderBy("label").collect()]
        if not classes:
            return Grid([(c, g, None) for c in costs for g in gammas], None, None)
        r = np.random.default_rng(seed)
        dim = data.select(F.size("v").alias("n")).first().n
        directions, shifts = r.normal(size=(many, dim)), r.uniform(0, 2 * math.pi, many)
        w, size = _trained(data, classes, directions, shifts, gammas, costs, folds, rounds)
        shared = data.sparkSession.sparkContext.broadcast(w)

        def right(total: np.ndarray, labels: pa.Array, x: np.ndarray, part: np.ndarray) -> None:
            truth = places(labels, classes)
            for k, gamma in enumerate(gammas):
                z = features(x, directions, shifts, gamma)
                for fold in np.unique(part):
                    own = part == fold
                    score = np.einsum("nf,fck->nck", z[own], shared.value[k][:, fold])
                    total[k, fold] += (score.argmax(2) == truth[own, None]).sum(0)

        hits = summed(data, (len(gammas), folds, len(costs)), right)[:, size > 0] / size[size > 0][:, None]
        cells = [(c, g, float(hits[k, :, i].mean())) for i, c in enumerate(costs) for k, g in enumerate(gammas)]
        cost, gamma, _ = max(cells, key=lambda c: c[2])
        best = w[gammas.index(gamma), :, folds, costs.index(cost)]
        return Grid(cells, (cost, gamma), Svm(classes, directions, shifts, gamma, best))
    finally:
        data.unpersist()


def predicted(rows: DataFrame, model: Svm | None, key: str, label: str, column: str) -> DataFrame:
    """(key, label, p): the class of the highest score, the first of equals; null for null vectors, such with null elements, and without a model."""
    v = F.col(column).cast("array<double>")
    kind = rows.schema[label].dataType
    source = rows.select(key, label, F.when(~F.exists(v, lambda x: x.isNull()) & (F.size(v) > 0), v).alias("v"))
    if model is None:
        return source.select(key, label, F.lit(None).cast(kind).alias("p"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            names = pa.array(shared.value.classes, batch.schema.field(1).type)
            at = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            place = np.full(batch.num_rows, -1)
            if len(at):
                place[at] = shared.value.scores(matrix(lists.drop_null())).argmax(1)
            p = names.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], p], names=[key, label, "p"])

    return source.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {label} {kind.simpleString()}, p {kind.simpleString()}")
