"""Reports, noisy signals and the sequence model against plain loops."""

from itertools import product

import numpy as np
import pytest

from cadenza.functions import kernels
from cadenza.operators import metrics, models, report

MODEL = {"weight": [[0.4, 0.6], [1.0]], "mu": [[0.0, 1.0], [2.0]], "var": [[1.0, 0.5], [1.5]], "start": [0.7, 0.3], "move": [[0.8, 0.2], [0.3, 0.7]]}


def density(x, k):
    return sum(w * np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v) for w, m, v in zip(MODEL["weight"][k], MODEL["mu"][k], MODEL["var"][k]))


def paths(x):
    for p in product((0, 1), repeat=len(x)):
        yield p, MODEL["start"][p[0]] * density(x[0], p[0]) * np.prod([MODEL["move"][a][b] * density(v, b) for a, b, v in zip(p, p[1:], x[1:])])


def test_recursions_against_all_paths():
    r = np.random.default_rng(2)
    waves = [r.normal(1, 1.5, n) for n in (4, 7, 1, 6)]
    start, move = np.zeros(2), np.zeros((2, 2))
    for x in waves:
        total = sum(w for _, w in paths(x))
        for p, w in paths(x):
            start[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                move[a, b] += w / total
    got = models.expected_counts(waves, MODEL)
    assert np.allclose(got[0], start) and np.allclose(got[1], move)
    for x, path in zip(waves, models.best_paths(waves, MODEL)):
        assert path.tolist() == list(max(paths(x), key=lambda k: k[1])[0])
    assert models.best_paths([], MODEL) == [] and not models.expected_counts([], MODEL)[1].any()


def test_hmm_finds_states(spark):
    r = np.random.default_rng(4)
    rows = []
    for file in range(6):
        state = 0
        for i in range(300):
            state = state if r.random() < 0.95 else 1 - state
            rows.append((file, i, float(r.normal(r.choice([-3, 3]) if state else 0, 0.8)), 300, state))
    seq = spark.createDataFrame(rows, "file int, i long, x double, n long, label int")
    model = models.hmm_fit(seq, mixtures=2)
    assert all(abs(model["move"][k][k] - 0.95) < 0.03 for k in (0, 1))
    assert sorted(round(m / 3) for m in model["mu"][1]) == [-1, 1]
    found = models.hmm_decode(seq, model).join(seq, ["file", "i"])
    assert found.count() == 1800 and found.where("state = label").count() > 1700
    assert models.hmm_decode(seq.limit(0), model).count() == 0
    assert models.hmm_fit(seq.limit(0))["start"] is not None


def test_segmentation_report_by_loop(spark):
    r = np.random.default_rng(9)
    rows = [(f, i, n, int(r.integers(-1, 2)), int(r.integers(0, 2)), int(r.integers(0, 2)), int(r.integers(0, 2))) for f, n in ((1, 60), (2, 45), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "file int, i long, n long, speech int, music int, es int, em int")
    ref, est = df.select("file", "i", "n", "speech", "music"), df.selectExpr("file", "i", "n", "es as speech", "em as music")
    for offsets in (False, True):
        found = {(k.tolerance, k.cls): k for k in report.segmentation_report(ref, est, [10, 35], offsets).collect()}
        want = {}
        for t in (10, 35):
            for cls, a, b in (("speech", 3, 5), ("music", 4, 6)):
                for f, n in ((1, 60), (2, 45), (3, 1)):
                    pairs = [(0, 0) if k[a] < 0 else (k[a], k[b]) for k in rows if k[0] == f]
                    rise = lambda c: [i for i in range(1, n) if (pairs[i][c] != pairs[i - 1][c] if offsets else pairs[i][c] > pairs[i - 1][c])]
                    near, ours, theirs = np.ceil(t / (10 * n + 15) * n), rise(0), rise(1)
                    tp = sum(any(abs(i - j) <= near for j in theirs) for i in ours)
                    for key in ((t, cls), (t, None)):
                        want[key] = np.add(want.get(key, 0), [tp, len(theirs) - tp, len(ours) - tp, len(ours)])
        assert {k: (v.tp, v.fp, v.fn, v.n) for k, v in found.items()} == {k: tuple(v) for k, v in want.items()}
    assert report.segmentation_report(ref.limit(0), est.limit(0), [10]).where("cls is not null").count() == 0


def test_smoothing_by_source(spark):
    scores = spark.createDataFrame([(1, i, v, 7) for i, v in enumerate([0.9, 0.1, 0.8, 0.5, 0.5, 0.2, 0.1])], "file int, i long, x double, n long")
    got = report.smoothed_scores(scores, 3).orderBy("i").collect()
    assert [(r.speech, r.music) for r in got] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0), (1, 0), (1, 0)]
    labels = spark.createDataFrame([(1, i, v, 5) for i, v in enumerate([1, 0, 0, 1, 1])], "file int, i long, m int, n long")
    assert [r.speech for r in report.shifted_labels(labels, -2).orderBy("i").collect()] == [0, 1, 1, 1, 0]
    assert [r.music for r in report.smoothed_labels(labels, 0).orderBy("i").collect()] == [0, 1, 1, 0, 0]


def test_noisy(spark):
    r = np.random.default_rng(1)
    x, z = {"a": r.normal(size=50), "b": r.normal(size=8)}, {"hum": r.normal(size=20), "silence": np.zeros(5)}
    waves = spark.createDataFrame([(k, v.tolist(), 1) for k, v in x.items()] + [("none", None, 1), ("empty", [], 1)], "file string, samples array<double>, noise int")
    noises = spark.createDataFrame([(k, v.tolist()) for k, v in z.items()], "noise string, samples array<double>")
    from pyspark.sql import functions as F

    got = report.noisy(waves, noises, [10, 0], F.when(F.col("file") == "a", 0).otherwise(3)).collect()
    assert len(got) == 4
    for row in got:
        assert row.noise == ("hum" if row.file == "a" else "silence")
        assert np.allclose(row.samples, kernels.mixed(x[row.file], z[row.noise], row.snr_db))
    again = lambda: {(r.file, r.noise) for r in report.noisy(waves, noises, [5]).collect()}
    assert again() == again() and report.noisy(waves, noises.limit(0), [5]).count() == 0


def test_stats_by_level(spark):
    rows = spark.createDataFrame([(10, 1, 1), (10, 0, 1), (0, 1, 0)], "snr_db int, y int, p int")
    found = {(r.snr_db, r.cls): (r.tp, r.fp, r.fn, r.precision) for r in metrics.segment_stats(rows, ["snr_db"]).collect()}
    assert found == {(10, 1): (1, 1, 0, 0.5), (10, 0): (0, 0, 1, None), (0, 1): (0, 0, 1, None), (0, 0): (0, 1, 0, 0.0)}
    assert pytest.approx(0.5) == found[10, 1][3]
