"""Silence removal and annotations against plain loops; patches, sums and the memo on small cases."""

import numpy as np
import pytest

from cadenza.operators import metrics, models, moments, patches, sequence, silence, stats
from cadenza.sources import audio

SIZE, HOP, FS = 8, 4, 10.0


def loop_silences(x, part, least):
    """Frame marks with the burst step, then spans of silence, sample by sample, as text-book loops."""
    n = len(x)
    count = (n - SIZE) // HOP + 1 if n >= SIZE else 0
    if not count:
        return []
    y = x - x.mean()
    y = y / np.abs(y).max() if np.abs(y).max() else y
    rms = np.array([np.sqrt((y[f * HOP : f * HOP + SIZE] ** 2).mean()) for f in range(count)])
    m = (rms >= part * rms.max()).astype(int)
    for i in range(20, count - 20):
        if m[i - 10 : i + 10].sum() <= 6:
            m[i] = 0
    out, i = [], 0
    while i < count:
        if m[i]:
            i += 1
            continue
        j = i
        while j < count - 1 and m[j] == 0:
            j += 1
        k, end = max(HOP * (i - 1) + SIZE, 1), min(HOP * (j - 1) + SIZE, n)
        if (end - k) / FS > least:
            out.append((k, end))
        i = j + 1
    return out


def made_signals():
    r = np.random.default_rng(5)
    found = {}
    for name, n in (("long", 900), ("mid", 300), ("short", 5), ("edge", 8), ("flat", 60)):
        loud = np.repeat(r.random(-(-n // 25)) > 0.5, 25)[:n]
        found[name] = np.zeros(n) if name == "flat" else r.normal(0, 1, n) * np.where(loud, 1, 0.02)
    found["long"][400:403] = 9  # a burst
    return found


@pytest.fixture(scope="module")
def seq(spark):
    return spark.createDataFrame([(f, i, float(v), len(x)) for f, x in made_signals().items() for i, v in enumerate(x)], "file string, i long, x double, n long")


@pytest.mark.parametrize("drop_tail", [False, True])
def test_silence_removed(seq, drop_tail):
    got = silence.silence_removed(seq, SIZE, HOP, FS, 0.2, 0.5, drop_tail).collect()
    for name, x in made_signals().items():
        spans = loop_silences(x, 0.2, 0.5)
        kept = np.ones(len(x), bool)
        for a, b in spans:
            kept[a:b] = False
        if drop_tail and spans:
            kept[spans[-1][1] :] = False
        own = sorted((r for r in got if r.file == name), key=lambda r: r.i)
        assert [r.x for r in own] == x[kept].tolist() and [r.i for r in own] == list(range(kept.sum())) and {r.n for r in own} <= {kept.sum()}
    assert loop_silences(made_signals()["long"], 0.2, 0.5)


def test_annotations_move_by_the_silence_before_them(spark):
    spans = [("a", 1.0, 2.0), ("a", 4.0, 7.0), ("b", 0.0, 1.0)]
    notes = [("a", 0.0, 1.0, "s"), ("a", 0.5, 1.0, "s"), ("a", 1.5, 0.25, "m"), ("a", 1.5, 1.0, "m"), ("a", 0.0, 9.0, "s"), ("a", 4.0, 3.0, "m"), ("a", 7.0, 1.0, "s"), ("a", 7.0, 1.0, "s"), ("c", 1.0, 1.0, "s"), (None, 1.0, 1.0, "s"), ("a", None, 1.0, "s")]
    got = silence.silence_shifted(spark.createDataFrame(notes, "file string, t0 double, dur double, cls string"), spark.createDataFrame(spans, "file string, t0 double, t1 double"))
    want = []
    for f, t, d, c in notes:
        if t is None:
            continue
        before = lambda at, f=f: sum(max(0, min(b, at) - a) for g, a, b in spans if g == f)
        if d - before(t + d) + before(t) > 0:
            want.append((f, t - before(t), d - before(t + d) + before(t), c))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 8


def test_markers_cover_the_shortened_signal(spark, seq):
    notes = spark.createDataFrame([("long", 0.0, 90.0, "s"), ("mid", 0.0, 3.0, "m")], "file string, t0 double, dur double, cls string")
    got = silence.annotation_markers(seq, notes, SIZE, HOP, FS, 0.2, 0.0).where("file = 'long'").collect()
    x = made_signals()["long"]
    left = len(x) - sum(b - a for a, b in loop_silences(x, 0.2, 0.0))
    assert sorted(r.i for r in got) == list(range(left // HOP))


def test_empty_tables(spark, seq):
    none = seq.limit(0)
    assert silence.silence_removed(none, SIZE, HOP, FS).count() == 0 and silence.long_enough(seq, FS, 2.0).select("file").distinct().count() == 3
    vectors = spark.createDataFrame([], "id long, label int, v array<double>")
    assert np.isnan(stats.first_canonical(vectors, "v", 1)) and np.isnan(stats.manova(vectors, "v", "label")["wilks"])
    assert models.mlp_predict(vectors, "label", "v", "id", [3]).count() == 0
    assert stats.pearson(vectors, "v").count() == 0 and sequence.patch_grid(none, 3, 2).count() == 0
    assert [r.f1 for r in metrics.f1_of_labels(spark.createDataFrame([], "y int, p int")).collect()] == [None]
    assert patches.patch_summaries(vectors.selectExpr("id as file", "id as i", "v"), 3, 2).count() == 0


def test_sums_of_products(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (200, 5))
    x[:, 4] = 2
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0, None, 1.0, 1.0, 1.0],)]
    vectors = spark.createDataFrame(rows, "v array<double>").repartition(3)
    found = moments.moments(vectors, "v")
    assert found.n == 200 and np.allclose(found.m, (x - x.mean(0)).T @ (x - x.mean(0))) and np.allclose(found.mean, x.mean(0))
    for row in stats.pearson(vectors, "v").collect():
        assert row.r is None or abs(row.r) < 1e-3 if row.b == 4 else abs(row.r - np.corrcoef(x[:, row.a], x[:, row.b])[0, 1]) < 1e-9


def test_patches_of_frames(spark):
    r = np.random.default_rng(4)
    files = {"a": r.normal(3, 2, (50, 3)), "b": r.normal(0, 1, (7, 3)), "c": np.full((20, 3), 5.0)}
    rows = [(f, i, v.tolist()) for f, x in files.items() for i, v in enumerate(x)] + [("a", 50, [1.0, float("nan"), 0.0]), ("a", 51, None), ("d", 0, [1.0, None, 2.0])]
    got = {(p.file, p.patch): p.v for p in patches.patch_summaries(spark.createDataFrame(rows, "file string, i long, v array<double>"), 16, 6).collect()}
    want = {}
    for f, x in files.items():
        z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), np.inf)
        while len(z) <= 16 and len(x) < 16:
            z = np.concatenate([z, (x - x.mean(0)) / x.std(0)])
        for p in range(-(-len(z) // 6)):
            at = min(p * 6, len(z) - 16)
            want[f, p] = [*z[at : at + 16].mean(0), *z[at : at + 16].var(0)]
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_memo_computes_what_is_missing(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.append(sorted(r.k for r in rows.collect()))
        return rows.selectExpr("k", "k * 2 as v")

    path = f"file://{tmp_path}/memo"
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    assert sorted(r.v for r in audio.memoised(rows(1, 2), path, ["k"], compute).collect()) == [2, 4]
    assert sorted(r.v for r in audio.memoised(rows(2, 3), path, ["k"], compute).collect()) == [4, 6]
    assert seen == [[1, 2], [3]]


def test_plans_have_no_pairs_within_a_file(spark):
    signal = spark.createDataFrame([("a", 0, 1.0, 1)], "file string, i long, x double, n long")
    plan = sequence.snr_gain(signal, signal, [0])._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "j#" in plan and "(file" in plan.split("Join Inner")[1]
