"""Hand-computed cases of the operators."""

import io
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import arrays, kernels
from cadenza.operators import fusion, metrics, models, sequence, signal, split, stats
from cadenza.sources import audio
from cadenza.streaming import windows


def marked(spark, values):
    return spark.createDataFrame([(1, i, m, len(values)) for i, m in enumerate(values)], "file int, i long, m int, n long")


def test_islands_and_mode_filter(spark):
    m = marked(spark, [1, 1, 0, 0, 0, 1, 0, 1, 1])
    runs = sorted((r.first, r.last, r.m) for r in sequence.islands(m).collect())
    assert runs == [(0, 1, 1), (2, 4, 0), (5, 5, 1), (6, 6, 0), (7, 8, 1)]
    y = [r.y for r in sequence.mode_filter(m, 4).orderBy("i").collect()]
    assert y == [1, 1, 0, 0, 0, 0, 0, 1, 1]


def test_negative_false_positives(spark):
    ref = spark.createDataFrame([(1, 10), (1, 12)], "file int, i long")
    est = spark.createDataFrame([(1, 11)], "file int, i long")
    row = metrics.matched_by_reference(ref, est, 1).first()
    assert (row.tp, row.fn, row.fp) == (2, 0, -1)
    row = metrics.matched_greedily(ref, est, 1).first()
    assert (row.tp, row.fn, row.fp) == (1, 1, 0)


def test_fold_sizes(spark):
    files = spark.createDataFrame([("a", k) for k in range(10)], "cls string, file int")
    sizes = [r["count"] for r in split.kfold(files, 4, ["file"]).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 3, 1]


def test_vote_tie_takes_smallest(spark):
    votes = spark.createDataFrame([(1, k, p) for k, p in enumerate([0, 0, 1, 1])], "key int, feat int, p int")
    assert fusion.majority_vote(votes, ["key"]).first().label == 0


def test_fusion_keeps_complete_keys_only(spark):
    rows = spark.createDataFrame([(k, f, [0.5, 0.5]) for f, n in ((0, 5), (1, 4)) for k in range(n)], "key int, feat int, p array<double>")
    assert fusion.complete(rows, ["key"], 2).select("key").distinct().count() == 4


def test_scaling_of_constants_and_nonfinite(spark):
    rows = spark.createDataFrame([(k, [float(k), 3.0, 1.0]) for k in range(5)], "id int, v array<double>")
    z = np.array([r.z for r in split.standard_scaled(rows, ["id"], [], "v").orderBy("id").collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z[:, 0].var(), 1) and (z[:, 1:] == 0).all()
    broken = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("-inf")],), ([1.0, 2.0],)], "v array<double>")
    assert broken.where(arrays.finite("v")).count() == 1


def test_short_sequences(spark):
    seq = spark.createDataFrame([(1, i, float(i), 3) for i in range(3)], "file int, i long, x double, n long")
    assert sequence.frame_mean_var(seq, 17, 8).count() == 0
    tiled = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(sequence.tiled("v", 7).alias("v")).first().v
    assert len(tiled) == 9


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 200), st.integers(1, 40), st.integers(1, 20))
def test_frame_count(n, size, hop):
    want = (n - size) // hop + 1 if n >= size else 0
    assert len(kernels.frames(np.zeros(n), size, hop)) == want


def test_kernels_on_a_tone():
    fs, n = 16_000, 16_000
    x = np.sin(2 * np.pi * 440 * np.arange(n) / fs)
    fr = kernels.frames(x, 400, 160)
    assert abs(np.abs(kernels.magnitudes(fr)).argmax(1).mean() * fs / 400 - 440) < 41
    eye = kernels.dct(np.eye(16), 16)
    assert np.allclose(eye @ eye.T, np.eye(16))
    for kernel in signal.FRAMES.values():
        v = kernel(fr, fs)
        assert len(v) == len(fr) and np.isfinite(v).all() and np.isfinite(kernel(fr * 0, fs)).all()
    for kernel in signal.BLOCKS.values():
        assert kernel(fr[:30], fs, 160).shape == (30, 13)
    assert abs(kernels.autocorrelation_peak(fr, fs)[:, 2].mean() - 440) < 5


def test_snr_of_mixture():
    r = np.random.default_rng(0)
    x, z = r.normal(size=4000), r.normal(size=900)
    y = kernels.mixed(x, z, 10)
    assert abs(np.abs(y).max() - 1) < 1e-6


def test_wav_round_trip(spark, tmp_path):
    x = (np.sin(np.arange(800) / 9) * 20_000).astype("<i2")
    folder = tmp_path / "music"
    folder.mkdir()
    with wave.open(str(folder / "a.b.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(x.tobytes())
    row = audio.read_waves(spark, str(tmp_path), 0).first()
    assert (row.file, row.cls, row.fs) == ("a", "music", 8000) and np.allclose(row.samples, x / 32768)
    assert len(audio.read_waves(spark, str(tmp_path), 16_000).first().samples) == 1600
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6.0).reshape(2, 3))
    (folder / "m.npy").write_bytes(buffer.getvalue())
    assert audio.read_matrices(spark, str(tmp_path), 3).count() == 2


def test_annotations_and_textgrids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0.5,1.5,|s|\n\n2.0,1.0,|m|\n")
    assert [(r.t0, r.cls) for r in audio.read_annotations(spark, str(tmp_path / "a.csv")).orderBy("t0").collect()] == [(0.5, "s"), (2.0, "m")]
    (tmp_path / "g.TextGrid").write_text('xmin = 0.0\n xmax = 1.5\n text = "s"\n xmin = 1.5\n xmax = 2.0\n text = "m"\n')
    assert [(r.label, r.duration) for r in audio.read_textgrids(spark, str(tmp_path / "g.TextGrid")).orderBy("xmin").collect()] == [("s", 1.5), ("m", 0.5)]


def test_canonical_correlation_and_manova(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4))
    x[:, 2] = x[:, 0] + 0.1 * r.normal(size=300)
    y = (r.random(300) > 0.5).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "v array<double>, y int")
    a, b = x[:, :2] - x[:, :2].mean(0), x[:, 2:] - x[:, 2:].mean(0)
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    assert abs(stats.first_canonical(rows, "v", 2) - np.linalg.svd(qa.T @ qb, compute_uv=False)[0]) < 1e-9
    got = stats.manova(rows, "v", "y")
    e = x.T @ x - np.outer(x.T @ y, x.T @ y) / (y @ y)
    assert abs(got["wilks"] - np.linalg.det(e) / np.linalg.det(x.T @ x)) < 1e-9
    mean, axes = stats.principal(rows, "v")
    z = np.array([q.z for q in stats.projected(rows, "v", mean, axes).collect()])
    assert z.var(0).sum() >= 0.95 * x.var(0).sum()


def test_viterbi_and_bursts():
    model = {"mu": [0.0, 10.0], "var": [1.0, 1.0], "start": [0.5, 0.5], "move": [[0.99, 0.01], [0.01, 0.99]]}
    x = np.array([0, 0, 9, 10, 10, 0, 0.0])
    assert models.viterbi(x, model).tolist() == [0, 0, 1, 1, 1, 0, 0]
    m = np.zeros(80, int)
    m[40] = 1
    assert kernels.bursts_suppressed(m).sum() == 0


def test_streamed_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = windows.tumbling(src, "6 hours")
    assert spark.table("w").agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0]


def test_unequal_lengths_are_filled(spark):
    rows = spark.createDataFrame([(1, i, float(i), 4) for i in range(4)], "file int, i long, x double, m long")
    got = sequence.tail_filled(rows, F.lit(6)).orderBy("i").collect()
    assert [(r.i, r.x) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 3)]


@pytest.mark.parametrize("n", [1, 5])
def test_median_is_zero_padded(spark, n):
    seq = spark.createDataFrame([(1, i, 5.0, n) for i in range(n)], "file int, i long, x double, n long")
    assert sequence.median_filter(seq, 5).where("i = 0").first().y == (5.0 if n == 5 else 0.0)
