"""Networks of dense layers, fitted by the gradients of all rows, several networks in shared passes.

Hidden layers are linear maps with rectifiers, the last one gives a softmax over the classes; the loss is the cross-entropy and half the decay times the squared
weights (not the biases). A pass takes the gradients of the training rows and the loss of the validation rows of every network that hasn't stopped, by Arrow batch and
then by task; the driver makes Adam's step. A network stops when its validation loss hasn't fallen by ``delta`` for ``patience`` epochs, and keeps its best weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix
from .training import by_hash, labelled, places, summed


@dataclass
class Network:
    """Weights as one flat array; losses are those of the validation rows before each epoch's step."""

    classes: list
    sizes: list[int]
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)
    best: int = 0

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the maps and biases in a flat array."""
        flat, out, at = self.weights if flat is None else flat, [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The classes' probabilities for the rows of a matrix."""
        return _softmax(self.forward(x)[-1])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        layers = self.layers()
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            x = np.maximum(x, 0) if k < len(layers) - 1 else x
            out.append(x)
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """The cross-entropy, summed over rows."""
        score = self.forward(x)[-1]
        top = score.max(1)
        return float((top + np.log(np.exp(score - top[:, None]).sum(1)) - score[np.arange(len(y)), y]).sum())

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """That of the summed cross-entropy by the flat weights."""
        passed = self.forward(x)
        back = _softmax(passed[-1])
        back[np.arange(len(y)), y] -= 1
        out = np.zeros_like(self.weights)
        for (w, _), (gw, gb), own in zip(self.layers()[::-1], self.layers(out)[::-1], passed[-2::-1]):
            gw += own.T @ back
            gb += back.sum(0)
            back = (back @ w.T) * (own > 0)
        return out

    def decayed(self) -> np.ndarray:
        """The weights with zeros for biases."""
        out = self.weights.copy()
        for _, b in self.layers(out):
            b[:] = 0
        return out


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def drawn(classes: list, sizes: list[int], seed: int) -> Network:
    """A network with weights drawn for rectifiers and biases of 0."""
    r = np.random.default_rng(seed)
    parts = [x for a, b in zip(sizes, sizes[1:]) for x in (r.normal(0, np.sqrt(2 / a), a * b), np.zeros(b))]
    return Network(classes, sizes, np.concatenate(parts))


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Patience:
    """Early stopping: when a loss hasn't fallen by ``delta`` below the best one for ``patience`` epochs."""

    def __init__(self, delta: float, patience: int):
        self.delta, self.patience, self.least, self.waited = delta, patience, float("inf"), 0

    def better(self, loss: float) -> bool:
        if self.least - loss > self.delta:
            self.least, self.waited = loss, 0
            return True
        self.waited += 1
        return False

    @property
    def over(self) -> bool:
        return self.waited >= self.patience


def fitted(rows: DataFrame, key: str, label: str, column: str, hidden: list[list[int]], held: float = 0.3, rate: float = 0.01, decay: float = 1e-4, delta: float = 0.01, patience: int = 5, epochs: int = 100, seed: int = 1) -> list[Network]:
    """A network for each list of hidden sizes. The rows of ``held`` of all keys' hashes are for validation, the others train.

    Rows with a null key, label or vector, or a null element, aren't used; no rows for training or none for validation give no networks. Classes are the labels that occur,
    few of them. Vectors should be scaled before (``split.standard_scaled``).
    """
    data = labelled(rows, key, label, column, (by_hash(key, 1000, seed) < int(1000 * held)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = [r.label for r in data.select("label").distinct().orderBy("label").collect()]
        many = {r.part: r["count"] for r in data.groupBy("part").count().collect()}
        if len(many) < 2:
            return []
        dim = data.select(F.size("v").alias("n")).first().n
        nets = [drawn(classes, [dim, *sizes, len(classes)], seed + k) for k, sizes in enumerate(hidden)]
        steps, stops, best = [Adam(len(n.weights), rate) for n in nets], [Patience(delta, patience) for _ in nets], [n.weights for n in nets]
        for epoch in range(epochs + 1):
            live = [k for k, s in enumerate(stops) if not s.over]
            if not live:
                break
            ends = np.cumsum([0, *(len(nets[k].weights) + 1 for k in live)])
            shared = data.sparkSession.sparkContext.broadcast([nets[k] for k in live])

            def take(total: np.ndarray, labels: pa.Array, x: np.ndarray, part: np.ndarray, ends=ends, shared=shared) -> None:
                y = places(labels, classes)
                for net, a, b in zip(shared.value, ends, ends[1:]):
                    total[a : b - 1] += net.gradient(x[part == 0], y[part == 0])
                    total[b - 1] += net.loss(x[part == 1], y[part == 1])

            sums = summed(data, (int(ends[-1]),), take)
            shared.unpersist()
            for k, a, b in zip(live, ends, ends[1:]):
                nets[k].losses.append(sums[b - 1] / many[1])
                if stops[k].better(nets[k].losses[-1]):
                    best[k], nets[k].best = nets[k].weights, epoch
                if not stops[k].over and epoch < epochs:
                    nets[k].weights = nets[k].weights - steps[k].step(sums[a : b - 1] / many[0] + decay * nets[k].decayed())
        for net, weights in zip(nets, best):
            net.weights = weights
        return nets
    finally:
        data.unpersist()


def predicted(rows: DataFrame, model: Network | None, key: str, label: str, column: str) -> DataFrame:
    """(key, label, shares array<double>, p): the classes' probabilities and the likeliest one, the first of equals.

    Null for null vectors, such with null elements, and without a model.
    """
    v = F.col(column).cast("array<double>")
    kind = rows.schema[label].dataType
    source = rows.select(key, label, F.when(~F.exists(v, lambda x: x.isNull()) & (F.size(v) > 0), v).alias("v"))
    if model is None:
        return source.select(key, label, F.lit(None).cast("array<double>").alias("shares"), F.lit(None).cast(kind).alias("p"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            lists = batch.column(2)
            names = pa.array(net.classes, batch.schema.field(1).type)
            at = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            place, shares = np.full(batch.num_rows, -1), [None] * batch.num_rows
            if len(at):
                found = net.shares(matrix(lists.drop_null()))
                place[at] = found.argmax(1)
                for k, row in zip(at.tolist(), found.tolist()):
                    shares[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shares, pa.list_(pa.float64())), names.take(pa.array(place, mask=place < 0))], names=[key, label, "shares", "p"])

    return source.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {label} {kind.simpleString()}, shares array<double>, p {kind.simpleString()}")
