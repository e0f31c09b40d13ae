"""The sequence model over files of any length: chunks meet at their borders only.

A chunk's effect on what comes after it is a states x states matrix: of likelihoods, for expected counts, and of best paths' scores. Tasks make
these matrices of all chunks, a scan along a file's chunks turns them into what each chunk gets from before and after it, and with that each chunk is
solved by itself. Only the matrices of a file come together, a few numbers for ``size`` samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import written

#: Samples of a chunk.
SIZE = 16_384


def chunked(seq: DataFrame, size: int = SIZE) -> DataFrame:
    """(file, chunk, samples) of rows (file, i, x), in order of i; null samples are 0. Rows without a file or place are left out."""
    rows = seq.where("file is not null and i is not null").select("file", F.floor(F.col("i") / size).cast("long").alias("chunk"), F.struct("i", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")).alias("s"))
    return rows.groupBy("file", "chunk").agg(F.sort_array(F.collect_list("s")).alias("s")).select("file", "chunk", F.col("s.x").alias("samples"))


class _Side:
    """Chunks side by side, longest first: likelihoods by place, and how many chunks have each place."""

    def __init__(self, waves: list[np.ndarray], first: np.ndarray, model: dict):
        from .models import padded

        logs, self.many, self.order = padded(waves, model)
        self.first = first[self.order]
        self.logs = logs
        self.likely = np.exp(logs - logs.max(2, keepdims=True)) if logs.size else logs
        self.move, self.start = np.array(model["move"]), np.array(model["start"])
        self.log_move, self.log_start = np.log(np.maximum(self.move, 1e-300)), np.log(np.maximum(self.start, 1e-300))

    def entry(self, matrix: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The first step of each chunk, by state before: a file's first chunk begins with the start's."""
        return np.where(self.first[:, None, None], start[None, None, :], matrix[None])

    def sums(self) -> np.ndarray:
        """Of each chunk, in the given order: likelihoods by state before and last state, scaled."""
        sums = self.entry(self.move, self.start) * self.likely[:, None, 0]
        for t, b in enumerate(self.many):
            if t:
                sums[:b] = (sums[:b] @ self.move) * self.likely[:b, None, t]
            sums[:b] /= np.maximum(sums[:b].max((1, 2), keepdims=True), 1e-300)
        return sums[np.argsort(self.order)]

    def best(self) -> np.ndarray:
        """Of each chunk, in the given order: the best paths' scores by state before and last state."""
        best = self.entry(self.log_move, self.log_start) + self.logs[:, None, 0]
        for t, b in enumerate(self.many[1:], 1):
            best[:b] = (best[:b, :, :, None] + self.log_move).max(2) + self.logs[:b, None, t]
        return best[np.argsort(self.order)]

    def counts(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected first states and moves, given the state's shares before each chunk and the likelihoods after it."""
        before, after = before[self.order], after[self.order]
        shape = self.likely.shape
        ahead, back = np.zeros(shape), np.ones(shape)
        for t, b in enumerate(self.many):
            step = (before[:b, None] @ self.entry(self.move, self.start)[:b])[:, 0] if t == 0 else ahead[:b, t - 1] @ self.move
            ahead[:b, t] = step * self.likely[:b, t]
            ahead[:b, t] /= np.maximum(ahead[:b, t].sum(1, keepdims=True), 1e-300)
        start, moves = np.zeros(len(self.start)), np.zeros(self.move.shape)

        def share(m: np.ndarray) -> np.ndarray:
            return m / np.maximum(m.sum(tuple(range(1, m.ndim)), keepdims=True), 1e-300)

        for t in range(shape[1] - 1, -1, -1):
            b = self.many[t]
            ends = np.arange(b) >= (self.many[t + 1] if t + 1 < len(self.many) else 0)
            back[:b, t][ends] = after[:b][ends]
            weight = self.likely[:b, t] * back[:b, t]
            if t:
                moves += share(ahead[:b, t - 1, :, None] * self.move * weight[:, None, :]).sum(0)
                back[:b, t - 1] = weight @ self.move.T
                back[:b, t - 1] /= np.maximum(back[:b, t - 1].max(1, keepdims=True), 1e-300)
            else:
                own, rest = self.first[:b], ~self.first[:b]
                start += share(self.start * weight[own]).sum(0)
                moves += share(before[:b][rest][:, :, None] * self.move * weight[rest][:, None, :]).sum(0)
        return start, moves

    def paths(self, enter: np.ndarray, leave: np.ndarray) -> list[np.ndarray]:
        """The best path of each chunk between the given states before and at its end."""
        enter, leave = enter[self.order], leave[self.order]
        came = np.zeros(self.logs.shape, np.int8 if len(self.start) < 128 else np.int64)
        for t, b in enumerate(self.many):
            if t == 0:
                best = self.entry(self.log_move, self.log_start)[np.arange(b), enter] + self.logs[:, 0]
            else:
                options = best[:b, :, None] + self.log_move
                came[:b, t] = options.argmax(1)
                best[:b] = options.max(1) + self.logs[:b, t]
        sizes = (np.arange(len(self.order))[:, None] < self.many[None, :]).sum(1)
        path = np.zeros(self.logs.shape[:2], int)
        path[np.arange(len(sizes)), sizes - 1] = leave
        for t in range(len(self.many) - 1, 0, -1):
            b = self.many[t]
            path[:b, t - 1] = came[np.arange(b), t, path[:b, t]]
        out: list = [None] * len(self.order)
        for row, k in enumerate(self.order):
            out[k] = path[row, : sizes[row]]
        return out


def _alive(sizes: np.ndarray) -> list[np.ndarray]:
    """For each k the places of the files' k-th chunks, of those that have one; files with most chunks first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return [starts[: np.searchsorted(-sizes, -k)] + k for k in range(sizes.max(initial=0))]


def shares(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State shares before and likelihoods after each chunk, of several files' chunks one file after another, in order; files go side by side."""
    n, s = sums.shape[:2]
    before, after = np.full((n, s), 1 / s), np.ones((n, s))
    alive = _alive(sizes)
    for at, following in zip(alive, alive[1:]):
        share = (before[at, None] @ sums[at])[: len(following), 0]
        before[following] = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
    for at in alive[:0:-1]:
        back = (sums[at] @ after[at, :, None])[:, :, 0]
        after[at - 1] = back / np.maximum(back.max(1, keepdims=True), 1e-300)
    return before, after


def borders(best: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best path's states before and at the end of each chunk; chunks as in ``shares``."""
    n, s = best.shape[:2]
    scores, came = np.zeros((len(sizes), s)), np.zeros((n, s), int)
    alive = _alive(sizes)
    for k, at in enumerate(alive):
        options = scores[: len(at), :, None] + best[at] if k else best[at]
        came[at], scores[: len(at)] = options.argmax(1), options.max(1)
    enter, leave = np.zeros(n, int), np.zeros(n, int)
    state = scores.argmax(1)
    for at in alive[::-1]:
        leave[at] = state[: len(at)]
        state[: len(at)] = enter[at] = came[at, state[: len(at)]]
    return enter, leave


def scanned(sums: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a file's chunks in order: state shares before and likelihoods after each, and the best path's states before and at the end of each."""
    one = np.array([len(sums)])
    return *shares(sums, one), *borders(best, one)


def _arrays(column: pd.Series, *shape: int) -> np.ndarray:
    return np.stack(column.to_list()).reshape(len(column), *shape) if len(column) else np.zeros((0, *shape))


def messages(chunks: DataFrame, model: dict, paths: bool) -> DataFrame:
    """(file, chunk, enter, leave) of chunks (file, chunk, samples) for paths, else (file, chunk, before, after); see ``borders`` and ``shares``."""
    states = len(model["start"])
    kind = chunks.schema["file"].dataType.simpleString()

    def effects(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                side = _Side(list(pdf["samples"]), (pdf["chunk"] == 0).to_numpy(), model)
                yield pd.DataFrame({"file": pdf["file"], "chunk": pdf["chunk"], "m": list((side.best() if paths else side.sums()).reshape(len(pdf), -1))})

    found = chunks.mapInPandas(effects, f"file {kind}, chunk long, m array<double>")
    files = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("c")).select("file", F.col("c.chunk").alias("chunk"), F.flatten("c.m").alias("m"))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                sizes = pdf["chunk"].map(len).to_numpy()
                found = (borders if paths else shares)(np.concatenate(pdf["m"].to_list()).reshape(-1, states, states), sizes)
                first, second = found if paths else map(list, found)
                yield pd.DataFrame({"file": pdf["file"].repeat(sizes).to_numpy(), "chunk": np.concatenate(pdf["chunk"].to_list()), names[0]: first, names[1]: second})

    names, each = (("enter", "leave"), "int") if paths else (("before", "after"), "array<double>")
    return files.mapInPandas(scan, f"file {kind}, chunk long, {names[0]} {each}, {names[1]} {each}")


def expected(chunks: DataFrame, model: dict) -> DataFrame:
    """(a, b, n): expected first states (b = -1) and moves from a to b over all files."""
    states = len(model["start"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                side = _Side(list(pdf["samples"]), (pdf["chunk"] == 0).to_numpy(), model)
                start, moves = side.counts(_arrays(pdf["before"], states), _arrays(pdf["after"], states))
                yield pd.DataFrame({"a": [*range(states), *np.repeat(range(states), states)], "b": [-1] * states + list(range(states)) * states, "n": [*start, *moves.ravel()]})

    whole = chunks.join(messages(chunks, model, False), ["file", "chunk"])
    return whole.mapInPandas(run, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))


def decoded(seq: DataFrame, model: dict, size: int = SIZE) -> DataFrame:
    """(file, i, state): the best path of each file of rows (file, i, x), i from 0 on without gaps; see ``chunked``."""
    chunks = written(chunked(seq, size), "chunks")
    kind = chunks.schema["file"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                paths = _Side(list(pdf["samples"]), (pdf["chunk"] == 0).to_numpy(), model).paths(pdf["enter"].to_numpy(), pdf["leave"].to_numpy())
                sizes = [len(p) for p in paths]
                at = np.concatenate([c * size + np.arange(n) for c, n in zip(pdf["chunk"], sizes)])
                yield pd.DataFrame({"file": pdf["file"].repeat(sizes).to_numpy(), "i": at, "state": np.concatenate(paths)})

    return chunks.join(messages(chunks, model, True), ["file", "chunk"]).mapInPandas(run, f"file {kind}, i long, state int")
