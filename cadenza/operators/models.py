"""Classifiers and the two-state sequence model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .signal import waves_of
from .split import unpivoted


def gaussian_fit(rows: DataFrame, label: str, column: str, smoothing: float = 1e-9) -> DataFrame:
    """(label, d, mu, var, prior): moments by class and element; var is raised by smoothing times the largest variance."""
    long = unpivoted(rows, [label], column).withColumn("v", F.col("v").cast("double"))
    extra = long.groupBy("d").agg(F.var_pop("v").alias("s")).agg((F.max("s") * smoothing).alias("extra"))
    moments = long.groupBy(F.col(label).alias("label"), "d").agg(F.avg("v").alias("mu"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return moments.join(F.broadcast(extra)).join(F.broadcast(total)).select("label", "d", "mu", (F.col("var") + F.col("extra")).alias("var"), (F.col("n") / F.col("total")).alias("prior"))


def gaussian_predict(rows: DataFrame, model: DataFrame, key: str, column: str) -> DataFrame:
    """(key, label): the class of the largest log-likelihood and prior."""
    term = -0.5 * F.log(2 * math.pi * F.col("var")) - (F.col("v") - F.col("mu")) * (F.col("v") - F.col("mu")) / (2 * F.col("var"))
    long = unpivoted(rows, [key], column).withColumn("v", F.col("v").cast("double"))
    likely = long.join(model, "d").groupBy(key, "label").agg((F.sum(term) + F.log(F.first("prior"))).alias("ll"))
    return likely.groupBy(key).agg(F.max_by("label", F.struct("ll", -F.col("label"))).alias("label"))


def mlp_predict(rows: DataFrame, label: str, column: str, key: str, hidden: list[int], seed: int = 1) -> DataFrame:
    """(key, label, p) of a multilayer perceptron that is trained on rows with a label whose hash is no multiple of 5; p is null for null vectors and such with null elements."""
    given = rows.where(F.col(label).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda v: v.isNull()))
    first = given.agg(F.max(F.size(column)).alias("n"), F.max(label).alias("k")).first()
    if first.n is None:  # no rows that could be trained on
        return rows.select(key, F.col(label).alias("label"), F.lit(None).cast("int").alias("p"))
    vector = array_to_vector(F.transform(column, lambda v: v.cast("double"))).alias("features")
    data = rows.where((F.size(column) > 0) & ~F.exists(column, lambda v: v.isNull())).select(key, label, vector)
    train = given.where(F.pmod(F.xxhash64(key), F.lit(5)) > 0).select(key, label, vector)
    model = MultilayerPerceptronClassifier(labelCol=label, layers=[first.n, *hidden, first.k + 1], maxIter=30, seed=seed).fit(train)
    found = model.transform(data).select(key, F.col(label).alias("label"), F.col("prediction").cast("int").alias("p"))
    rest = rows.where(~F.coalesce((F.size(column) > 0) & ~F.exists(column, lambda v: v.isNull()), F.lit(False)))
    return found.union(rest.select(key, label, F.lit(None).cast("int")))


def emissions_fit(seq: DataFrame, states: int = 2, mixtures: int = 1, seed: int = 1) -> dict:
    """Normal densities of the samples x of each label, as {"weight", "mu", "var"}, lists by state of lists by component.

    With several mixtures each label's samples are fitted by expectation maximisation; labels that no sample has get one of mean 0 and
    variance 1, null samples or labels are left out.
    """
    known = seq.where("label is not null and x is not null").select("label", F.col("x").cast("double").alias("x"))
    model = {"weight": [[1.0]] * states, "mu": [[0.0]] * states, "var": [[1.0]] * states}
    found = {r.label: r for r in known.groupBy("label").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"), F.count_distinct("x").alias("n")).collect()}
    for k in set(found) & set(range(states)):
        row = found[k]
        if mixtures == 1 or row.n <= mixtures:
            model["mu"][k], model["var"][k] = [row.mu], [max(row.var, 1e-6)]
            continue
        fitted = GaussianMixture(k=mixtures, seed=seed).fit(known.where(F.col("label") == k).select(array_to_vector(F.array("x")).alias("features")))
        model["weight"][k] = [float(w) for w in fitted.weights]
        model["mu"][k] = [float(g.mean[0]) for g in fitted.gaussians]
        model["var"][k] = [max(float(g.cov.toArray()[0, 0]), 1e-6) for g in fitted.gaussians]
    return model


def hmm_fit(seq: DataFrame, states: int = 2, rounds: int = 5, mixtures: int = 1, chunk: int | None = None) -> dict:
    """Emissions by labelled samples (file, i, x, n, label); start and transitions by Baum-Welch with these fixed.

    Labels may be a classifier's own (``metrics.argmax_label`` of its scores) where there's no truth. Files are made arrays once and kept;
    expected counts are taken by Arrow batch of files and summed by Spark; a round moves states * (states + 1) numbers to the driver.
    With ``chunk`` files are cut into chunks of so many samples (``chunks.expected``), so that no task needs a whole file.
    """
    model = emissions_fit(seq, states, mixtures) | {
        "start": [1 / states] * states,
        "move": [[0.9 if a == b else 0.1 / max(states - 1, 1) for b in range(states)] for a in range(states)],
    }
    waves = (waves_of(seq) if chunk is None else chunks.chunked(seq, chunk)).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        if chunk is None:
            found = waves.mapInPandas(_expected(dict(model), states), "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))
        else:
            found = chunks.expected(waves, dict(model))
        counts = found.collect()
        start, move = np.zeros(states), np.full((states, states), 1e-9)
        for r in counts:
            if r.b < 0:
                start[r.a] = r.n
            else:
                move[r.a, r.b] += r.n
        model["start"] = (start / max(start.sum(), 1e-12)).tolist()
        model["move"] = (move / move.sum(1, keepdims=True)).tolist()
    waves.unpersist()
    return model


def _expected(model: dict, states: int):
    """Expected counts of batches of files: starts as (state, -1), moves as (state, state)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            start, move = expected_counts(list(pdf["samples"]), model)
            yield pd.DataFrame({"a": [*range(states), *np.repeat(range(states), states)], "b": [-1] * states + list(range(states)) * states, "n": [*start, *move.ravel()]})

    return run


def padded(waves: list[np.ndarray], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods (file, place, state) of files, longest first; the number of files that have each place; the files' order."""
    sizes = np.array([len(w) for w in waves], int)
    order = np.argsort(-sizes, kind="stable")
    x = np.zeros((len(waves), sizes.max(initial=0)))
    for row, k in enumerate(order):
        x[row, : sizes[k]] = waves[k]
    logs = []
    weights = model.get("weight", [1.0] * len(model["mu"]))
    for weight, mu, var in zip(*(map(np.atleast_1d, values) for values in (weights, model["mu"], model["var"]))):
        parts = np.stack([np.log(max(w, 1e-300)) - 0.5 * np.log(2 * np.pi * v) - (x - m) ** 2 / (2 * v) for w, m, v in zip(weight, mu, var)])
        top = parts.max(0)
        logs.append(top + np.log(np.exp(parts - top).sum(0)))
    return np.stack(logs, 2), (sizes[:, None] > np.arange(x.shape[1])).sum(0), order


def expected_counts(waves: list[np.ndarray], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Expected first states and moves, summed over files, whose recursions run side by side."""
    e, many, _ = padded(waves, model)
    e = np.exp(e - e.max(2, keepdims=True))
    start, move = np.array(model["start"]), np.array(model["move"])
    ahead, back, scale = np.zeros(e.shape), np.ones(e.shape), np.ones(e.shape[:2])
    for t, b in enumerate(many):
        ahead[:b, t] = (start if t == 0 else ahead[:b, t - 1] @ move) * e[:b, t]
        scale[:b, t] = np.maximum(ahead[:b, t].sum(1), 1e-300)
        ahead[:b, t] /= scale[:b, t, None]
    moves = np.zeros(move.shape)
    for t in range(e.shape[1] - 2, -1, -1):
        b = many[t + 1]
        after = e[:b, t + 1] * back[:b, t + 1] / scale[:b, t + 1, None]
        back[:b, t] = after @ move.T
        moves += ahead[:b, t].T @ after * move
    first = (ahead[: many[0], 0] * back[: many[0], 0]).sum(0) if len(many) else np.zeros(len(start))
    return first, moves


def viterbi(x: np.ndarray, model: dict) -> np.ndarray:
    """The best path of one file; states of one density each may be given as plain numbers, without weights."""
    return best_paths([x], model)[0]


def best_paths(waves: list[np.ndarray], model: dict) -> list[np.ndarray]:
    """The best path of each file, the smaller state among equals."""
    e, many, order = padded(waves, model)
    move = np.log(np.maximum(model["move"], 1e-300))
    best, came = np.log(np.maximum(model["start"], 1e-300)) + e[:, 0] if len(many) else None, np.zeros(e.shape, int)
    for t in range(1, len(many)):
        b = many[t]
        options = best[:b, :, None] + move
        came[:b, t] = options.argmax(1)
        best[:b] = options.max(1) + e[:b, t]
    out = [np.zeros(0, int)] * len(waves)
    for row, k in enumerate(order):
        path = np.zeros(len(waves[k]), int)
        if len(path):
            path[-1] = best[row].argmax()
            for t in range(len(path) - 1, 0, -1):
                path[t - 1] = came[row, t, path[t]]
        out[k] = path
    return out


def hmm_decode(seq: DataFrame, model: dict) -> DataFrame:
    """(file, i, state): the best path of each file of rows (file, i, x, n). Null samples count as 0."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            paths = best_paths(list(pdf["samples"]), model)
            sizes = [len(p) for p in paths]
            yield pd.DataFrame({"file": pdf["file"].repeat(sizes).to_numpy(), "i": np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)]), "state": np.concatenate(paths or [np.zeros(0, int)])})

    kind = seq.schema["file"].dataType.simpleString()
    return waves_of(seq).mapInPandas(run, f"file {kind}, i long, state int")


def scored(rows: DataFrame, score, key: str, column: str) -> DataFrame:
    """(key, p) with score(matrix) -> matrix of a model given as a function: the hook for networks trained elsewhere."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "p": list(np.asarray(score(np.stack(pdf[column].to_list())), float))})

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, p array<double>")
