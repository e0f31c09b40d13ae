"""Patches as arrays, scores of files, name matching, kept models, and small things that had no test, against plain loops."""

import cmath
import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrays, kernels
from cadenza.operators import report, signal, stats, tensors
from cadenza.sources import audio, store
from cadenza.streaming import windows


def frames_of(spark, files):
    rows = [(f, i, v.tolist()) for f, x in files.items() for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (None, 0, [1.0, 2.0])], "file string, i long, v array<double>").repartition(3)


def loop_scaled(x, size):
    x = x[np.isfinite(x).all(1)]
    if not len(x):
        return x
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    z[:, x.std(0) == 0] = 0
    return np.concatenate([z] * (size // len(z) + 1)) if len(z) < size else z


@pytest.fixture(scope="module")
def files():
    r = np.random.default_rng(1)
    x = {"long": r.normal(3, 2, (53, 2)), "short": r.normal(0, 1, (5, 2)), "one": np.ones((1, 2)), "bad": r.normal(0, 1, (20, 2)), "exact": r.normal(0, 1, (8, 2))}
    x["bad"][3, 1] = np.nan
    x["bad"][7, 0] = np.inf
    return x


def test_centred_patches_by_loop(spark, files):
    for size, step in ((8, 3), (7, 4)):
        got = {(q.file, q.patch): np.array(q.m) for q in tensors.centred_patches(frames_of(spark, files), size, step).collect()}
        want = {}
        for f, x in files.items():
            z = loop_scaled(x, size)
            h = size // 2
            padded = np.concatenate([np.zeros((h, 2)), z, np.zeros((h, 2))])
            for k, c in enumerate(range(h, len(padded) - h, step)):
                want[f, k] = padded[c - h : c + h]
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert tensors.centred_patches(frames_of(spark, files).limit(0), 8, 3).collect() == []


def test_random_patches_are_the_same_each_time(spark, files):
    df = frames_of(spark, files)
    got = {(q.file, q.patch): np.array(q.m) for q in tensors.random_patches(df, 8, 3, seed=5, pick=[1]).collect()}
    again = {(q.file, q.patch): np.array(q.m) for q in tensors.random_patches(df.repartition(7), 8, 3, seed=5, pick=[1]).collect()}
    other = {(q.file, q.patch): np.array(q.m) for q in tensors.random_patches(df, 8, 3, seed=6, pick=[1]).collect()}
    assert set(got) == set(again) == set(other) and all(np.allclose(got[k], again[k]) for k in got) and any((got[k] != other[k]).any() for k in got)
    starts = {f: set() for f in files}
    for f, x in files.items():
        z = loop_scaled(x, 8)[:, 1:]
        assert {p for g, p in got if g == f} == set(range(-(-len(z) // 3)))
        for (g, p), m in got.items():
            if g == f:
                at = [s for s in range(len(z) - 7) if np.allclose(z[s : s + 8], m)]
                assert at
                starts[f].add(at[0])
    assert len(starts["long"]) > 8


def test_wave_patches_by_loop(spark):
    r = np.random.default_rng(2)
    x = {"a": r.normal(5, 1, 70), "b": np.array([1.0, 3.0]), "c": np.full(40, 2.0)}
    df = spark.createDataFrame([(f, i, float(v)) for f, w in x.items() for i, v in enumerate(w)], "file string, i long, x double")
    got = tensors.wave_patches(df, 16, 10).collect()
    assert {(q.file, q.patch) for q in got} == {("a", k) for k in range(7)} | {("b", k) for k in range(2)} | {("c", k) for k in range(4)}
    for q in got:
        w = x[q.file] - x[q.file].mean()
        w = w / (np.ptp(x[q.file]) or 1)
        w = np.tile(w, 16 // len(w) + 1) if len(w) < 16 else w
        assert any(np.allclose(w[s : s + 16], q.m) for s in range(len(w) - 15))


def test_labels_of_patches(spark, files):
    patches = tensors.centred_patches(frames_of(spark, files), 8, 3)
    labels = spark.createDataFrame([("long", i, i % 7) for i in range(31)], "file string, i long, y int")
    got = {q.patch: q.y for q in tensors.labelled_patches(patches, labels, 3).collect()}
    assert got == {k: 3 * k % 7 for k in range(11)}


def test_fused_scores_by_loop(spark):
    r = np.random.default_rng(3)
    sizes = {("a", "x"): 9, ("a", "y"): 7, ("a", "z"): 12, ("b", "y"): 4, ("b", "z"): 1, ("c", "z"): 2}
    p = {k: r.random((n, 2)) for k, n in sizes.items()}
    scores = spark.createDataFrame([(f, g, i, v.tolist()) for (f, g), x in p.items() for i, v in enumerate(x)] + [("a", "unknown", 0, [9.0, 9.0])], "file string, feat string, patch long, p array<double>")
    labels = spark.createDataFrame([("a", k, k % 2) for k in range(8)] + [("b", k, 1) for k in range(20)] + [("c", 1, 0)], "file string, patch long, y int")
    want = {}
    for f in "abc":
        total = None
        for g in "xyz":
            if (f, g) in p:
                own = p[f, g]
                if total is None:
                    total = own.copy()
                    continue
                d = len(total) - len(own)
                places = [k if k < len(own) else max(k - d, 0) for k in range(len(total))]
                total += own[places]
        want |= {(f, k): v / 3 for k, v in enumerate(total)}
    got = {(q.file, q.patch): np.array(q.p) for q in tensors.fused_scores(scores, ["x", "y", "z"]).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    cut = tensors.fused_scores(scores, ["x", "y", "z"], labels).collect()
    assert {(q.file, q.patch, q.y) for q in cut} == {("a", k, k % 2) for k in range(8)} | {("b", k, 1) for k in range(4)} | {("c", 1, 0)}
    assert tensors.fused_scores(scores.limit(0), ["x"]).collect() == []


def test_names_meet_by_part(spark):
    files = ["rec1", "rec12", "a", "ä", "a_very_long_name_of_a_file", "none", "aaaaaaaa", None, ""]
    names = ["x/rec1_fold0", "rec12_fold0_b", "rec12_fold0", "zza_fold0", "a_fold1", "p-a_very_long_name_of_a_file_fold0", "ä_fold0", "aaaaaaaaa_fold0", None, "rec12_fold0"]
    got = {q.file: q.prediction for q in tensors.named_match(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame([(n,) for n in names], "name string"), "_fold0").collect()}
    want = {}
    for f in filter(None, files):
        met = sorted((n for n in names if n and f + "_fold0" in n), key=lambda n: (len(n), n.encode()))
        if met:
            want[f] = met[0]
    assert got == want and len(want) == 6
    plan = tensors.named_match(spark.range(9).selectExpr("cast(id as string) as file"), spark.range(9).selectExpr("cast(id as string) as name"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and plan.count("Cross") == 0


def test_models_are_kept_by_version(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    r = np.random.default_rng(4)
    first = {"weights": r.normal(size=(3, 4)), "steps": np.arange(5, dtype=np.int32), "classes": ["a", 1, None], "rate": 0.1, "empty": np.zeros((0, 2))}
    with pytest.raises(LookupError):
        store.load_model(spark, path)
    assert store.save_model(spark, path, first) == 1 and store.save_model(spark, path, {"rate": 2}) == 2
    back = store.load_model(spark, path, 1)
    assert set(back) == set(first) and back["classes"] == ["a", 1, None] and back["rate"] == 0.1
    assert all((back[k] == first[k]).all() and back[k].dtype == first[k].dtype and back[k].shape == first[k].shape for k in ("weights", "steps", "empty"))
    assert store.load_model(spark, path) == {"rate": 2} and store.versions(spark, path) == [1, 2]
    with pytest.raises(TypeError):
        store.save_model(spark, path, {"x": np.array([object()])})
    with pytest.raises(LookupError):
        store.load_model(spark, path, 9)


def test_segmentation_results_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, [0.2, 0.8], 1, 0, 1, "more"), ("a", 1, None, None, 1, 0, "more")], "file string, i int, p array<float>, y_sp int, y_mu int, hmm long, extra string")
    store.write_segmentation(rows.limit(1), f"file://{tmp_path}/s")
    store.write_segmentation(rows.where("i = 1"), f"file://{tmp_path}/s")
    got = store.read_segmentation(spark, f"file://{tmp_path}/s").orderBy("i").collect()
    assert [(q.file, q.i, q.y_sp, q.y_mu, q.hmm) for q in got] == [("a", 0, 1, 0, 1), ("a", 1, None, 1, 0)] and np.allclose(got[0].p, [0.2, 0.8]) and got[1].p is None


def test_group_delays_by_loop(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(3, 10)), np.zeros((1, 10))])
    df = spark.createDataFrame([("f", k, v.tolist()) for k, v in enumerate(x)], "file string, frame long, samples array<double>")
    for q in signal.group_delays(df, 8000).collect():
        w, nfft = kernels.zero_time(x[q.frame][None])
        w = w[0]
        if not x[q.frame].any():
            assert all(not any(q[k]) for k in signal.DELAYS)
            continue
        a = [sum(v * cmath.exp(-2j * math.pi * k * n / nfft) for n, v in enumerate(w)) for k in range(nfft)]
        b = [sum(n * v * cmath.exp(-2j * math.pi * k * n / nfft) for n, v in enumerate(w)) for k in range(nfft)]
        ngd = np.array([u.real * v.real + u.imag * v.imag for u, v in zip(a, b)])
        mag = np.abs(a)
        bins = nfft // 2 + 1
        gd = (ngd / (mag + 1e-10)) ** 2
        scale = np.abs(ngd).max()
        assert np.allclose(q.ngd, ngd[:bins], atol=1e-9 * scale) and np.allclose(q.mag, mag[:bins]) and np.allclose(q.gd, gd[:bins], rtol=1e-6)
        assert np.allclose(q.mgd, np.sqrt(np.abs(ngd) / (mag + 1e-10))[:bins], rtol=1e-6)
        for whole, d, h in ((ngd, q.dngd, q.hngd), (gd, q.dgd, q.hgd)):
            circle = np.concatenate([whole] * 3)
            two = [-(circle[k + 2] - 2 * circle[k + 1] + circle[k]) for k in range(nfft - 2, nfft - 2 + bins)]
            assert np.allclose(d, two, atol=1e-8 * np.abs(whole).max()) and np.allclose(h, np.abs(kernels.analytic(np.diff(circle, n=3)[None]))[0, nfft - 4 : nfft - 4 + bins], rtol=1e-6, atol=1e-8 * np.abs(whole).max())
    assert signal.group_delays(df.limit(0), 8000).collect() == []


def test_one_noise_for_many_waves(spark, monkeypatch):
    """The copies of a noise change nothing."""
    monkeypatch.setattr(report, "WAVES", 3)
    r = np.random.default_rng(6)
    waves = spark.createDataFrame([(k, r.normal(size=12).tolist()) for k in range(20)] + [(None, [1.0])], "file long, samples array<double>")
    noises = spark.createDataFrame([("n", r.normal(size=5).tolist()), ("m", r.normal(size=7).tolist())], "noise string, samples array<double>")
    few = sorted(map(tuple, report.noisy(waves, noises, [5.0], F.lit(1)).collect()), key=repr)
    monkeypatch.setattr(report, "WAVES", 1000)
    assert few == sorted(map(tuple, report.noisy(waves, noises, [5.0], F.lit(1)).collect()), key=repr) and {q[1] for q in few} == {"n"} and len(few) == 21


def test_small_expressions(spark):
    v = list(map(float, range(78)))
    row = spark.createDataFrame([(v,)], "v array<double>").select(
        arrays.summary_subset("v").alias("a"), arrays.repeated(F.slice("v", 1, 2), 3).alias("b"), arrays.next_power_of_2(F.lit(17)).alias("c"), arrays.next_power_of_2(F.lit(16)).alias("d"),
        arrays.named_value(F.lit("f1:0.5:x")).alias("e"), arrays.steps_per_epoch(F.lit(3.6), F.lit(680), 16).alias("f"), arrays.hz_e(arrays.mel_e(F.lit(440.0))).alias("g"), arrays.stem(F.lit("/a/b.c.wav")).alias("h"),
    ).first()
    assert row.a == [x for k in range(6) for x in v[13 * k : 13 * k + 7]] and row.b == [0.0] * 3 + [1.0] * 3 and (row.c, row.d) == (32, 16)
    assert tuple(row.e) == ("f1", "0.5:x") and row.f == int(3.6 * 3.6e6 / 680 * 0.66 * 0.7 / 32) and abs(row.g - 440) < 1e-9 and row.h == "b"


def test_whitening(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 3)) @ r.normal(size=(3, 3)) + 5
    w = stats.zca(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v")
    c = x - x.mean(0)
    assert np.allclose(np.cov((c @ w).T, bias=True), np.eye(3), atol=1e-3) and np.allclose(w, w.T)


def test_sinks_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("mfcc", "speech", "a", 0, [1.0]), ("mfcc", "music", "b", 0, [2.0])], "feat string, cls string, file string, frame int, v array<double>")
    audio.write_features(rows, f"file://{tmp_path}/f")
    audio.write_features(rows.limit(1), f"file://{tmp_path}/f")
    assert spark.read.parquet(f"file://{tmp_path}/f/feat=mfcc/cls=speech").count() == 2
    assert [q.file for q in audio.missing(spark.createDataFrame([("a",), ("c",)], "file string"), rows).collect()] == ["c"]
    audio.write_results(rows.select("file", "frame"), f"file://{tmp_path}/r")
    assert spark.read.csv(f"file://{tmp_path}/r", sep="\t", header=True).columns == ["file", "frame"]
    assert {q.key: q.value for q in audio.config_rows(spark, {"a": [1, 2], "b": object()}).collect()} == {"a": "[1, 2]", "b": "ERROR"}
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, at(0)), (1, at(4)), (1, at(20)), (2, at(1))], "user_id long, ts timestamp")
    assert sorted((q.user_id, q.n) for q in windows.sessions(events, "10 seconds").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_noise_report_from_waves_to_scores(spark):
    """Tones against noise: clean files are told apart, loud noise blurs them; every held-out file counts once a level and family."""
    from cadenza.operators import recognition

    r = np.random.default_rng(12)
    t = np.arange(400) / 8000
    waves = [(f"t{k}", "tone", (np.sin(2 * np.pi * (300 + 20 * k) * t) + 0.05 * r.normal(size=400)).tolist()) for k in range(20)] + [(f"n{k}", "hiss", r.normal(size=400).tolist()) for k in range(20)]
    odd = [(None, "tone", [0.0] * 400), ("x", None, [0.0] * 400), ("y", "tone", None), ("z", "tone", [1.0, 2.0])]
    schema = "file string, cls string, samples array<double>"
    df = spark.createDataFrame(waves + odd, schema).repartition(3)
    noises = spark.createDataFrame([("w", r.normal(size=150).tolist())], "noise string, samples array<double>")
    setting = recognition.Setting(80, 40, 4, 2, 8000)
    args = dict(levels=[20.0, -30.0], families=["log_mel", "zero_crossings"], setting=setting, hidden=[6], epochs=25, rate=0.05)
    got = {(q.snr_db, q.feat, q.label): q for q in recognition.noise_report(df, noises, **args).collect()}
    for level in (None, 20.0, -30.0):
        for feat in ("log_mel", "zero_crossings", "fused"):
            own = [q for (d, f, _), q in got.items() if d == level and f == feat]
            assert sum(q.n for q in own) == sum(q.said for q in own) == 12 and all(q.n == 6 for q in own if q.n)
    score = lambda level: sum(q.tp for (d, f, _), q in got.items() if d == level and f == "fused")
    assert score(None) >= 11 and score(20.0) >= 10 and score(-30.0) <= 9
    q = got[None, "fused", "tone"]
    assert q.precision == q.tp / q.said and q.recall == q.tp / 6 and abs(q.f1 - 2 * q.tp / (6 + q.said)) < 1e-12
    assert recognition.noise_report(df.limit(0), noises, **args).collect() == []


def test_centred_patches_are_scaled_once(spark):
    """Frames are scaled when patches are asked for, and not again by what reads the patches."""
    read = spark.sparkContext.accumulator(0)

    def row(k):
        read.add(1)
        return k % 2, k // 2, [float(k), 1.0]

    frames = spark.createDataFrame(spark.sparkContext.parallelize(range(20), 2).map(row), "file int, i long, v array<double>")
    patches = tensors.centred_patches(frames, 4, 2)
    before = read.value
    assert patches.count() == len(patches.collect()) == 10 and read.value == before > 0
