"""Classifiers trained in passes, balancing and the chunked sequence model, against plain loops."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import balance, chunks, models, network, svm, training

SCHEMA = "id long, label int, v array<double>, z string"


def blobs(spark, many=300, dim=4, classes=3, seed=1, parts=5):
    """Labelled clusters, and rows with nulls that aren't trained on."""
    r = np.random.default_rng(seed)
    centre = r.normal(0, 1.6, (classes, dim))
    rows = [(k, k % classes, (centre[k % classes] + r.normal(0, 0.7, dim)).tolist(), "x") for k in range(many)]
    odd = [(900, None, [0.0] * dim, "x"), (901, 1, None, "x"), (902, 1, [None] * dim, "x"), (903, 0, [], "x")]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(parts), np.array([q[2] for q in rows]), np.array([q[1] for q in rows])


def folds_of(df, parts, seed):
    return {q.id: q.part for q in df.select("id", training.by_hash("id", parts, seed).alias("part")).collect()}


def test_svm_grid_meets_a_plain_loop(spark):
    df, x, y = blobs(spark)
    costs, gammas, folds, many, rounds = [0.25, 4.0], [0.1, 1.0], 3, 32, 12
    got = svm.grid(df, "id", "label", "v", costs, gammas, folds, many, rounds, seed=2)
    part = folds_of(df, folds, 2)
    part = np.array([part[k] for k in range(len(x))])
    r = np.random.default_rng(2)
    directions, shifts = r.normal(size=(many, x.shape[1])), r.uniform(0, 2 * math.pi, many)

    def machine(z, sign, cost, bound):
        """One machine by the same steps, row sums written out."""
        w = ahead = np.zeros(z.shape[1])
        t = 1.0
        for _ in range(rounds):
            g = ahead / (cost * len(z)) - 2 * sum(s * max(0, 1 - s * (row @ ahead)) * row for row, s in zip(z, sign)) / len(z)
            new = ahead - g / (bound / len(z) + 1 / (cost * len(z)))
            later = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / later * (new - w), new, later
        return w

    cells = []
    for cost, gamma in itertools.product(costs, gammas):
        z = np.array([[math.sqrt(2 / many) * math.cos(math.sqrt(2 * gamma) * (d @ v) + s) for d, s in zip(directions, shifts)] + [1.0] for v in x])
        bound = 2 * np.linalg.eigvalsh(z.T @ z)[-1]
        hits = []
        for k in range(folds):
            w = np.array([machine(z[part != k], np.where(y[part != k] == c, 1, -1), cost, bound) for c in range(3)])
            hits.append(np.mean((z[part == k] @ w.T).argmax(1) == y[part == k]))
        cells.append((cost, gamma, np.mean(hits)))
        if (cost, gamma) == got.best:
            whole = np.array([machine(z, np.where(y == c, 1, -1), cost, bound) for c in range(3)]).T
            assert np.allclose(whole, got.model.weights, atol=1e-9)
    assert [c[:2] for c in got.cells] == [c[:2] for c in cells] and np.allclose([c[2] for c in got.cells], [c[2] for c in cells])
    assert got.best == max(cells, key=lambda c: c[2])[:2] and max(c[2] for c in cells) > 0.8
    said = {q.id: q.p for q in svm.predicted(df, got.model, "id", "label", "v").collect()}
    assert len(said) == 304 and said[901] is said[902] is said[903] is None and said[900] is not None
    assert np.mean([said[k] == y[k] for k in range(300)]) > 0.85


def test_svm_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = svm.grid(none, "id", "label", "v", [1.0], [1.0, 2.0])
    assert found.cells == [(1.0, 1.0, None), (1.0, 2.0, None)] and found.best is found.model is None
    assert svm.predicted(none, None, "id", "label", "v").collect() == []
    one = spark.createDataFrame([(1, 4, [1.0, 2.0], "x")], SCHEMA)
    found = svm.grid(one, "id", "label", "v", [1.0], [1.0])
    assert [q.p for q in svm.predicted(one, found.model, "id", "label", "v").collect()] == [4]


def test_gradients_against_differences():
    r = np.random.default_rng(3)
    net = network.drawn([0, 1, 2], [4, 5, 6, 3], 1)
    net.weights += r.normal(0, 0.1, len(net.weights))
    x, y = r.normal(size=(20, 4)), r.integers(3, size=20)
    g = net.gradient(x, y)
    for k in range(len(g)):
        old = net.weights[k]
        net.weights[k] = old + 1e-6
        up = net.loss(x, y)
        net.weights[k] = old - 1e-6
        down = net.loss(x, y)
        net.weights[k] = old
        assert abs((up - down) / 2e-6 - g[k]) < 1e-4
    assert np.allclose(net.shares(x).sum(1), 1)


def test_networks_stop_where_a_plain_loop_does(spark):
    df, x, y = blobs(spark, seed=4)
    hidden = [[8], [6, 6], []]
    args = dict(held=0.3, rate=0.05, decay=1e-3, delta=0.02, patience=2, epochs=25)
    nets = network.fitted(df, "id", "label", "v", hidden, seed=5, **args)
    held = folds_of(df, 1000, 5)
    held = np.array([held[k] < 300 for k in range(len(x))])
    for k, (net, sizes) in enumerate(zip(nets, hidden)):
        own = network.drawn([0, 1, 2], [4, *sizes, 3], 5 + k)
        m, v = np.zeros(len(own.weights)), np.zeros(len(own.weights))
        losses, least, waited, best = [], float("inf"), 0, None
        for epoch in range(26):
            losses.append(own.loss(x[held], y[held]) / held.sum())
            if least - losses[-1] > 0.02:
                least, waited, best = losses[-1], 0, (epoch, own.weights.copy())
            else:
                waited += 1
            if waited == 2 or epoch == 25:
                break
            g = own.gradient(x[~held], y[~held]) / (~held).sum() + 1e-3 * own.decayed()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            own.weights -= 0.05 * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        assert np.allclose(net.losses, losses) and net.best == best[0] and np.allclose(net.weights, best[1])
    assert any(len(n.losses) < 26 for n in nets)
    said = {q.id: q for q in network.predicted(df, nets[0], "id", "label", "v").collect()}
    assert said[901].p is None and said[902].shares is None and np.mean([said[k].p == y[k] for k in range(300)]) > 0.8
    assert network.fitted(df.limit(0), "id", "label", "v", [[3]]) == []
    assert network.predicted(df.limit(0), None, "id", "label", "v").collect() == []


def test_perceptron_takes_null_vectors_and_labels(spark):
    df, x, y = blobs(spark, 120, seed=6)
    said = {q.id: q.p for q in models.mlp_predict(df, "label", "v", "id", [6]).collect()}
    assert len(said) == 124 and said[901] is said[902] is said[903] is None and said[900] is not None
    assert np.mean([said[k] == y[k] for k in range(120)]) > 0.7


@pytest.mark.parametrize("block", [4_096, 7])
def test_nearest_by_brute_force(spark, block):
    """Ties on a small lattice go to the lesser id; groups of one and of fewer than k rows; a null group."""
    r = np.random.default_rng(7)
    rows = [(k, [0, 0, 0, 1, None][k % 5], r.integers(0, 3, 2).astype(float).tolist()) for k in range(90)] + [(200, 7, [0.0, 0.0]), (201, 8, [1.0, 0.0]), (202, 8, [1.0, 5.0])]
    got = {q.id: [(n.d, n.id) for n in q.near] for q in balance.nearest(spark.createDataFrame(rows, "id long, grp int, v array<double>"), 4, block).collect()}
    for i, g, v in rows:
        d = sorted((float(sum((a - b) ** 2 for a, b in zip(v, w))), j) for j, h, w in rows if h == g and j != i)
        assert got[i] == d[:4]
    assert balance.nearest(spark.createDataFrame([], "id long, grp int, v array<double>"), 4).collect() == []


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_few_pairs_are_measured_exactly(shift):
    """A block's nearest rows by brute force, bit by bit, though few distances are summed by element; copies, far from the origin too, and rows beyond numbers."""
    r = np.random.default_rng(9)
    y = r.normal(0, 1, (3_000, 8)) + shift
    y[50:60] = y[40]
    names = r.permutation(3_000)
    base, seen = balance.Block(pa.array(names), y), [0]
    measured = base.distances
    base.distances = lambda x, rows, at: (seen.__setitem__(0, seen[0] + len(at)), measured(x, rows, at))[1]
    x, own = np.concatenate([y[:100], r.normal(0, 1, (20, 8)) + shift]), np.r_[np.arange(100), np.full(20, -1)]
    row, at, d = base.near(x, own, 5)
    assert seen[0] < 120 * 60
    for k in range(120):
        exact = sum(((y[:, c] - x[k, c]) ** 2 for c in range(1, 8)), (y[:, 0] - x[k, 0]) ** 2)
        want = sorted((exact[n], names[n]) for n in range(3_000) if n != own[k])[:5]
        assert list(zip(d[row == k], names[at[row == k]])) == want
    odd = balance.Block(pa.array([1, 2, 3, 4]), np.array([[1e200, 0], [0, 1], [0, 2], [np.nan, 0]]))
    assert odd.near(np.array([[0.0, 0.0]]), np.array([-1]), 2)[1].tolist() == [1, 2]


def test_smote_and_editing(spark):
    r = np.random.default_rng(8)
    rows = [(k, 0 if k < 60 else 1 if k < 72 else 2, (r.normal(0, 1, 3) + (k >= 60) * 2).tolist(), "x") for k in range(73)] + [(900, None, [0.0] * 3, "x"), (901, 1, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    made = balance.smote(df, "id", "label", "v", 5, block=16).collect()
    sizes = {c: sum(q.label == c for q in made) for c in range(3)}
    assert sizes == {0: 60, 1: 60, 2: 60} and sum(q.copy == 0 for q in made) == 73
    x = {i: np.array(v) for i, c, v, _ in rows if c is not None and v}
    label = {i: c for i, c, v, _ in rows}
    turns = {}
    for q in made:
        if q.copy == 0:
            assert np.allclose(q.v, x[q.id]) and q.label == label[q.id]
            continue
        turns[q.id] = turns.get(q.id, 0) + 1
        same = sorted((float(((x[j] - x[q.id]) ** 2).sum()), j) for j in x if label[j] == label[q.id] and j != q.id)[:5]
        away = np.array(q.v) - x[q.id]
        steps = [(x[j] - x[q.id]) for _, j in same] or [np.zeros(3)]
        assert any(np.allclose(away, s * (away @ s) / max(s @ s, 1e-300)) and -1e-12 <= away @ s <= s @ s + 1e-12 for s in steps)
    assert set(turns) == {i for i in x if label[i]} and turns[72] == 59 and {turns[i] for i in range(60, 72)} == {4}
    again = balance.smote(df.repartition(3), "id", "label", "v", 5).collect()
    key = lambda q: (q.id, q.copy)
    assert sorted(map(tuple, again), key=lambda q: q[:2]) == sorted(map(tuple, made), key=lambda q: q[:2])
    kept = {key(q) for q in balance.smote_enn(df, "id", "label", "v", 5, 3, block=16).collect()}
    point = {key(q): np.array(q.v) for q in made}
    name = {key(q): f"{q.id}+{q.copy}" for q in made}
    want = set()
    for q in made:
        near = sorted((float(((point[key(o)] - point[key(q)]) ** 2).sum()), name[key(o)], o.label) for o in made if key(o) != key(q))[:3]
        if all(c == q.label for _, _, c in near):
            want.add(key(q))
    # Sums of squares in another order may part ties; none is here.
    assert kept == want and len(kept) < len(made)
    ready = balance.prepared(df, "id", "label", "v").collect()
    z = np.array([q.z for q in ready])
    assert {key(q) for q in ready} == kept and np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)
    assert balance.prepared(df.limit(0), "id", "label", "v").collect() == []


MODEL = {"weight": [[1.0], [0.4, 0.6], [1.0]], "mu": [[0.0], [2.0, 3.0], [-2.0]], "var": [[1.0], [0.5, 2.0], [1.5]], "start": [0.5, 0.2, 0.3], "move": [[0.9, 0.06, 0.04], [0.1, 0.8, 0.1], [0.02, 0.08, 0.9]]}


def waves(spark, sizes, seed=9):
    r = np.random.default_rng(seed)
    x = {k: np.repeat(r.normal(0, 2, -(-n // 9)), 9)[:n] + r.normal(0, 1, n) for k, n in enumerate(sizes)}
    rows = [(f"f{k}", i, float(v), len(w), None) for k, w in x.items() for i, v in enumerate(w)]
    return spark.createDataFrame(rows, "file string, i long, x double, n long, label int").repartition(4), x


def test_chunks_meet_whole_files(spark):
    """Files of many chunks, of one chunk exactly, of one sample."""
    df, x = waves(spark, [1_000, 64, 65, 1, 300])
    whole = models.best_paths(list(x.values()), MODEL)
    got = {(q.file, q.i): q.state for q in chunks.decoded(df, MODEL, 64).collect()}
    assert got == {(f"f{k}", i): int(s) for k, path in enumerate(whole) for i, s in enumerate(path)}
    start, move = models.expected_counts(list(x.values()), MODEL)
    counts = {(q.a, q.b): q.n for q in chunks.expected(chunks.chunked(df, 64), MODEL).collect()}
    assert np.allclose([counts[a, -1] for a in range(3)], start, atol=1e-9)
    assert np.allclose([[counts[a, b] for b in range(3)] for a in range(3)], move, rtol=1e-9)
    assert chunks.decoded(df.limit(0), MODEL, 64).collect() == []


def test_one_long_file_in_fifty_chunks(spark):
    r = np.random.default_rng(10)
    x = np.repeat(r.normal(0, 2, 5_000), 20) + r.normal(0, 1, 100_000)
    df = spark.createDataFrame(pd.DataFrame({"file": "f", "i": np.arange(100_000), "x": x})).repartition(6)
    path = models.best_paths([x], MODEL)[0]
    got = chunks.decoded(df, MODEL, 2_000).orderBy("i").toPandas()
    assert (got["state"].to_numpy() == path).all() and len(got) == 100_000
    start, move = models.expected_counts([x], MODEL)
    counts = {(q.a, q.b): q.n for q in chunks.expected(chunks.chunked(df, 2_000), MODEL).collect()}
    assert np.allclose([[counts[a, b] for b in range(3)] for a in range(3)], move, rtol=1e-8) and np.allclose([counts[a, -1] for a in range(3)], start, atol=1e-9)


def test_fit_by_chunks_is_the_fit_by_files(spark):
    df, x = waves(spark, [200, 90, 33], 11)
    df = df.withColumn("label", (F.col("x") > 0).cast("int"))
    one, two = models.hmm_fit(df, 2, 3), models.hmm_fit(df, 2, 3, chunk=32)
    assert np.allclose(one["move"], two["move"]) and np.allclose(one["start"], two["start"])


def test_files_are_scanned_side_by_side():
    """Chunks of many files in one pass, against plain loops over each file's chunks."""
    r = np.random.default_rng(12)
    sizes = np.array([3, 1, 7, 1, 2, 7])
    sums, best = r.random((sizes.sum(), 3, 3)), r.normal(0, 1, (sizes.sum(), 3, 3))
    before, after = chunks.shares(sums, sizes)
    enter, leave = chunks.borders(best, sizes)
    for at, n in zip(np.cumsum(sizes) - sizes, sizes):
        share, score = np.full(3, 1 / 3), np.zeros(3)
        for k in range(at, at + n):
            assert np.allclose(before[k], share)
            share = share @ sums[k] / (share @ sums[k]).sum()
        back = np.ones(3)
        for k in range(at + n - 1, at - 1, -1):
            assert np.allclose(after[k], back)
            back = sums[k] @ back / (sums[k] @ back).max()
        paths = {}
        for states in np.ndindex(*[3] * (n + 1)):  # a state before the file and one at the end of each chunk
            paths[states] = sum(best[at + k][states[k], states[k + 1]] for k in range(n))
        top = max(paths, key=paths.get)
        assert enter[at : at + n].tolist() == list(top[:-1]) and leave[at : at + n].tolist() == list(top[1:])
    assert all(len(x) == 0 for x in (*chunks.shares(sums[:0], sizes[:0]), *chunks.borders(best[:0], sizes[:0])))
