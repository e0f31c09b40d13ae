"""Signal operators against plain loops, one frame, band and sample at a time."""

import numpy as np
import pyarrow as pa
import pytest

from cadenza.functions import kernels
from cadenza.operators import signal

FS, SIZE, HOP = 2000, 64, 24


def wave(n=1500, seed=3):
    r = np.random.default_rng(seed)
    t = np.arange(n) / FS
    return np.sin(2 * np.pi * 130 * t) * (1 + 0.5 * np.sin(2 * np.pi * 4 * t)) + 0.2 * r.normal(size=n)


@pytest.fixture(scope="module")
def waves(spark):
    rows = [("long", wave().tolist()), ("mid", wave(200, 5).tolist()), ("flat", [0.0] * 150), ("short", [1.0] * 10), ("none", None), ("nulls", [None] * 100)]
    return spark.createDataFrame([(*r, 1) for r in rows], "file string, samples array<double>, v int")


def loop_dct(x, n):
    return np.array([sum(v * np.cos(np.pi / len(x) * (m + 0.5) * k) for m, v in enumerate(x)) for k in range(n)])


def test_frames_by_both_ways(spark, waves):
    found = {(r.file, r.frame): r.samples for r in signal.frames_of_waves(waves, SIZE, HOP).collect()}
    seq = [(f, i, v, len(x)) for f, x in waves.select("file", "samples").toPandas().itertuples(index=False) if x is not None for i, v in enumerate(x)]
    rows = spark.createDataFrame(seq, "file string, i long, x double, n long")
    assert found == {(r.file, r.frame): r.samples for r in signal.frames_of(rows, SIZE, HOP).collect()}
    want = kernels.frames(wave(), SIZE, HOP)
    assert np.array_equal(want, [found["long", k] for k in range(len(want))]) and ("short", 0) not in found and ("none", 0) not in found
    assert found["nulls", 0] == [0.0] * SIZE
    assert {r.file: r.samples for r in signal.waves_of(rows).collect()}["mid"] == wave(200, 5).tolist()
    assert signal.frames_of_waves(waves.limit(0), SIZE, HOP).count() == signal.with_series(waves.limit(0), ["residual"], FS, SIZE, HOP).count() == 0


def test_slopes(spark):
    r = np.random.default_rng(1)
    made = {n: r.normal(size=(n, 2)) for n in (1, 2, 3, 5, 6, 9, 30)}
    df = spark.createDataFrame([(n, k, row.tolist()) for n, v in made.items() for k, row in enumerate(v)], "file int, frame long, v array<double>")
    found = {}
    for row in signal.with_slopes(df).orderBy("file", "frame").collect():
        found.setdefault(row.file, []).append(row.v)

    def loop(v):
        n = len(v)
        if n < 3:
            return v
        width = min(9, n) - (1 - min(9, n) % 2)
        h = width // 2
        out = []
        for k in range(n):
            c = min(max(k, h), n - 1 - h)
            out.append(np.polyfit(np.arange(-h, h + 1), v[c - h : c + h + 1], 1)[0])
        return np.array(out)

    for n, v in made.items():
        d = loop(v)
        assert np.allclose(found[n], np.concatenate([v, d, loop(d)], 1))


def test_hngd_cepstra_by_loop():
    x = wave(SIZE)
    w = np.zeros(SIZE)
    for n in range(1, SIZE):
        c = np.cos(np.pi * n / SIZE)
        w[n] = 2 * (1 + c) / (2 * (1 - c)) ** 2
    nfft = 128
    a, b = np.fft.fft(x * w, nfft), np.fft.fft(x * w * np.arange(SIZE), nfft)
    top = (a * b.conj()).real
    three = np.diff(np.diff(np.diff(np.concatenate([top, top, top]))))
    spectrum = np.fft.fft(three)
    for k in range(len(three)):
        spectrum[k] *= 1 if k in (0, len(three) / 2) else 2 if k < len(three) / 2 else 0
    envelope = np.abs(np.fft.ifft(spectrum))[nfft - 4 : nfft - 4 + nfft // 2][::-1]
    assert np.allclose(kernels.hngd(x[None], FS)[0], envelope)
    f, mel = np.linspace(0, FS / 2, 33), 1127 * np.log(1 + FS / 2 / 700)
    edge = [700 * (np.exp(m * mel / 23 / 1127) - 1) for m in range(23)]
    logs = []
    for m in range(21):
        total = 0
        for k in range(33):
            if edge[m] <= f[k] <= edge[m + 2]:
                near = (f[k] - edge[m]) / (edge[m + 1] - edge[m]) if f[k] <= edge[m + 1] else (edge[m + 2] - f[k]) / (edge[m + 2] - edge[m + 1])
                total += envelope[k] * near * 2 / (edge[m + 2] - edge[m])
        logs.append(np.log(total + 1e-5))
    want = [np.sqrt(2 / 21) * sum(v * np.cos(k * (np.pi * (m + 1) - 0.5) / 21) for m, v in enumerate(logs)) * (1 + 10.5 * np.sin(np.pi * k / 21)) for k in range(13)]
    assert np.allclose(kernels.hngd_cepstra(x[None], FS)[0], want)


def test_modified_group_delay_by_loop():
    fr = kernels.frames(wave(400), SIZE, HOP)
    a, b = np.fft.rfft(fr, 512), np.fft.rfft(fr * np.arange(SIZE), 512)
    log = np.log(np.abs(a))
    wide = np.pad(log, 2, "symmetric")
    middle = np.array([[np.median(wide[r : r + 5, c : c + 5]) for c in range(257)] for r in range(len(fr))])
    want = []
    for row in range(len(fr)):
        c = loop_dct(middle[row], 30)
        smooth = [c[0] / 257 + 2 / 257 * sum(c[k] * np.cos(np.pi / 257 * (m + 0.5) * k) for k in range(1, 30)) for m in range(257)]
        tau = (a[row] * b[row].conj()).real / np.exp(smooth) ** 0.6
        want.append(np.sign(tau) * np.abs(tau) ** 0.1)
    want = np.array(want) / np.abs(want).max()
    assert np.allclose(kernels.modified_group_delay(fr, FS, HOP), [2 * loop_dct(v[::-1][:13], 13) for v in want], atol=1e-6)


def test_instantaneous_frequency_by_loop():
    fr = kernels.frames(wave(300), SIZE, HOP)
    x = wave(300)[: HOP * (len(fr) - 1) + SIZE] * 2**15
    n, bands = len(x), 16
    half = n // 2 + 1
    out = np.zeros((len(fr), bands))
    for b in range(bands):
        own = np.zeros(n, complex)
        for k in range(half):
            own[k] = np.fft.fft(x)[k] * np.exp(-0.5 * (k / (half - 1) * (bands - 1) - (b - 1)) ** 2)
        z, dz = np.fft.ifft(own), np.fft.ifft(own * np.arange(n))
        num, den = (z.conj() * dz).real, (z * z.conj()).real
        for f in range(len(fr)):
            for j, w in enumerate(np.hamming(SIZE)):
                t = f * HOP + j
                part = slice(max(t - SIZE, 0), t + 1)
                out[f, b] += w * (num[part].sum() / (den[part].sum() + 1e-10) * 2 * np.pi / n - (np.round(b / (bands - 1) * half) - 1) / n * 2 * np.pi)
    assert np.allclose(kernels.instantaneous_frequency(fr, FS, HOP, bands), [2 * loop_dct(v[::-1][:13], 13) for v in out])


def test_blocks_and_sweep(spark, waves):
    frames = signal.frames_of_waves(waves, SIZE, HOP)
    fr = kernels.frames(wave(), SIZE, HOP)
    for family, kernel in signal.BLOCKS.items():
        found = signal.by_block(frames, family, FS, HOP, block=25).where("file = 'long'").orderBy("frame").collect()
        assert np.allclose([r.v for r in found], np.concatenate([kernel(fr[k : k + 25], FS, HOP) for k in range(0, len(fr), 25)]))
    rows = signal.swept(frames, [0.1, 0.5], [0.3, 0.9])
    assert rows.count() == 4 * frames.count()
    one = rows.where("rho = 0.5 and gamma = 0.9 and file = 'mid'").orderBy("frame").collect()
    assert np.allclose([r.v for r in one], kernels.modified_group_delay(kernels.frames(wave(200, 5), SIZE, HOP), FS, HOP, 0.5, 0.9))
    assert signal.phase_features(frames, FS, HOP).where("size(hngd) = 39 and size(mgd) = 39 and size(ifc) = 39").count() == frames.count()


def test_short_blocks_go_together(spark, waves):
    """A kernel takes many short blocks at once, in which each keeps its own scale and median."""
    frames = signal.frames_of_waves(waves, SIZE, HOP).coalesce(1)
    seen = signal._block_rows(frames.repartition(1), 2, lambda xs: [(7, np.full((sum(map(len, xs)), 1), len(xs)))]).collect()
    assert len(seen) == frames.count() and {(r.file, r.frame) for r in seen} == {(r.file, r.frame) for r in frames.collect()}
    assert max(r.v[0] for r in seen) > 2 and {r.setting for r in seen} == {7}
    many = [kernels.frames(wave(), SIZE, HOP)[a:b] for a, b in ((0, 3), (3, 4), (4, 25))] + [np.zeros((2, SIZE))]
    together = dict(kernels.modified_group_delays(many, [(0.5, 0.9), (0.2, 0.9), (0.2, 0.1)]))
    for number, setting in enumerate([(0.5, 0.9), (0.2, 0.9), (0.2, 0.1)]):
        assert np.allclose(together[number], np.concatenate([kernels.modified_group_delay(x, FS, HOP, *setting) for x in many]))


def test_frames_are_taken_in_slices():
    """Whatever a batch holds, a kernel of frames gets a bounded number of samples, and no frame is lost."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array([[0.0] * 64] * 5_000)], names=["frame", "samples"])
    parts = list(signal._slices(iter([batch, batch.slice(0, 0)]), "samples"))
    assert len(parts) > 5 and max(len(p["samples"].flatten()) for p in parts) <= signal.SAMPLES
    assert [k for p in parts for k in p["frame"].to_pylist()] == list(range(5_000))
    wide = pa.RecordBatch.from_arrays([pa.array([[0.0] * (signal.SAMPLES + 1)] * 2)], names=["samples"])
    assert [p.num_rows for p in signal._slices(iter([wide]), "samples")] == [1, 1]


def test_peaks():
    assert kernels.peaks(np.array([0, 2, 1, 3, 3, 3, 1, 1, 4.0])).tolist() == [1, 4]
    assert kernels.peaks(np.array([1.0, 1.0, 1.0])).tolist() == kernels.peaks(np.zeros(0)).tolist() == []
    assert kernels.peaks(np.array([0, 1, 1, 0.0])).tolist() == [1]


def test_zero_frequency_by_loop():
    for fs, n in ((FS, 300), (1000, 5), (1000, 1)):
        x, w = wave(n), round(16 * fs / 1000)
        y = [x[min(i + 1, n - 1)] - x[min(i, n - 2)] for i in range(n)] if n > 1 else [0.0]
        y = [v / (max(map(abs, y)) + 1e-10) for v in y]
        for _ in range(4):
            y = [sum(y[: i + 1]) for i in range(n)]
        for _ in range(4):
            y = [y[i] - np.mean(y[max(i - w // 2, 0) : i + (w - 1) // 2 + 1]) for i in range(n)]
        want = [v if 2 * w <= i < n - 2 * w else 0 for i, v in enumerate(y)]
        assert np.allclose(kernels.zero_frequency(x, fs), want, rtol=1e-6, atol=1e-6)


def test_residual_of_a_recursion():
    """A second-order recursion driven by pulses leaves the pulses."""
    x, drive = np.zeros(1200), np.zeros(1200)
    drive[50::90] = 1
    for i in range(2, 1200):
        x[i] = 1.2 * x[i - 1] - 0.8 * x[i - 2] + drive[i]
    res = kernels.residual(x, 1000, 400, 100)
    covered = np.arange(100, 800)
    assert np.abs(res[covered][drive[covered] == 0]).max() < 0.5 * res[covered][drive[covered] == 1].min()
    order, fr = 5, x[300:700]
    a = kernels.burg(fr * np.blackman(400), order)
    want = [sum(a[k] * x[300 + i - k] for k in range(order + 1)) for i in range(100)]
    assert np.allclose(res[300:400], want)
    assert not kernels.residual(np.zeros(500), 1000, 100, 50).any()


def test_sharpened_by_loop():
    h, p = np.abs(wave(60)), 4
    want = []
    for i in range(60):
        part = h[: i + p] if i < p else h[i - p : i + p] if i < 60 - p else h[i:]
        want.append(h[i] * h[i] / (part.mean() + 1e-10))
    assert np.allclose(kernels.sharpened(h, FS), want)


def test_sidelobe_ratio_by_loop():
    x = wave(700)
    e, s = kernels.residual_envelope(x, FS, SIZE, HOP), kernels.strengths(kernels.zero_frequency_wave(x, FS, SIZE, HOP))
    place, ratio = [], []
    for at in np.flatnonzero(s / (1.05 * s.max()) > 0.01):
        v = e[at - 12 : at + 12]
        tops = [k for k in range(1, len(v) - 1) if v[k - 1] < v[k] > v[k + 1]]
        k = max(tops, key=lambda t: v[t]) if tops else 0
        c = at - 13 + k
        ok = c - 31 > 0 and c + 31 <= len(e)
        place.append(c)
        ratio.append(v[k] / (np.var(e[c - 31 : c + 31]) + 1e-10) if ok else 0)
    assert len(place) > 5 and place == sorted(place)
    want = [ratio[next((k for k, c in enumerate(place) if c >= i), -1)] / max(ratio) for i in range(700)]
    assert np.allclose(kernels.sidelobe_ratio(x, FS, SIZE, HOP), want)


def test_filters_and_modulation():
    fs = 8000
    gain = lambda b, f: abs(np.exp(-2j * np.pi * f / fs * np.arange(len(b))) @ b)
    low, band = kernels.low_pass(200, 28 / (fs / 2)), kernels.band_filter(400, 600, fs)
    assert abs(gain(low, 0) - 1) < 1e-9 and gain(low, 200) < 0.01
    assert gain(band, 590) > 0.8 and gain(band, 450) == pytest.approx(0.25, abs=0.02) and gain(band, 300) < 0.01 > gain(band, 700)
    b, x = kernels.low_pass(11, 0.3), wave(50)
    assert np.allclose(kernels.filtered(x, b, 5, 5), np.convolve(b, x)[5:-5])
    r = np.random.default_rng(0)
    t = np.arange(4 * fs) / fs
    speech = np.concatenate([r.normal(size=len(t)) * (1 + np.sin(2 * np.pi * hz * t)) for hz in (4, 19)])
    m = kernels.modulation_spectrum(speech, fs, 80, 10)
    assert m.max() == pytest.approx(1) and m[: len(m) // 3].mean() > 5 * m[-len(m) // 3 :].mean()
    y = kernels.modulation_wave(speech, fs, 640, 80)
    assert len(y) == len(speech) and y.min() == m.min()


def test_epochs_by_loop(spark):
    z = kernels.zero_frequency_wave(wave(400), FS, SIZE, HOP)
    rows = [("a", i, float(v)) for i, v in enumerate(z)] + [("b", i, 0.0) for i in range(30)]
    found = signal.epochs(spark.createDataFrame(rows, "file string, i long, z double"), FS).orderBy("i").collect()
    at = [i for i in range(1, 399) if z[i] <= 0 < z[i + 1]]
    s = np.array([abs(z[i + 1] - z[i - 1]) for i in at])
    s = s / s.max()
    f0 = [FS / (b - a) for a, b in zip(at, at[1:])]
    assert len(at) > 5 and [r.i for r in found] == at
    assert np.allclose([r.strength for r in found], s, atol=1e-6) and np.allclose([r.f0 for r in found], [*f0, f0[-1]])
    assert [r.voiced for r in found] == (s > 0.7 * s.mean()).tolist()


def test_matrices_are_their_parts(spark, waves):
    some = waves.where("file in ('long', 'mid')")
    found = signal.source_features(some, FS, SIZE, HOP).where("file = 'long'").orderBy("frame").collect()
    x = wave()
    fr = kernels.frames(x, SIZE, HOP)
    series = {name: kernels.frames(kernel(x, FS, SIZE, HOP), SIZE, HOP) for name, kernel in signal.WAVES.items()}
    e = (fr**2).mean(1)
    flux, before = [], None
    for row in fr:
        s = np.abs(np.fft.fft(row, 2 * SIZE))[:SIZE]
        s = s / (s.max() + 1e-10)
        flux.append(0 if before is None else ((s - before) ** 2).sum())
        before = s
    shape = kernels.spectral_shape(fr, FS)
    zcr = [sum((a < 0) != (b < 0) for a, b in zip(row, row[1:])) / SIZE for row in fr]
    columns = [kernels.autocorrelation_peak(series["zero_frequency"], FS)[:, 0], series["modulation_4hz"].mean(1), series["sidelobe_ratio"].mean(1), zcr, e]
    columns += [kernels.log_mel_sum(fr, FS)[:, 0], shape[:, 0], flux, shape[:, 1], np.full(len(fr), (e < 0.5 * e.mean()).mean())]
    assert np.allclose([r.v for r in found], np.stack(columns, 1))
    marks = spark.createDataFrame([("long", k, int(k % 3 == 0)) for k in range(len(fr))], "file string, frame long, m int")
    got = signal.texture_features(some, marks, FS, SIZE, HOP).orderBy("file", "frame").collect()
    runs = sum(a != b for a, b in zip([k % 3 == 0 for k in range(len(fr))], [k % 3 == 0 for k in range(1, len(fr))])) + 1
    silent = sum(k % 3 == 1 for k in range(len(fr)))
    want = np.stack([np.sqrt(e), zcr, shape[:, 0], flux, np.full(len(fr), np.mean([k % 3 > 0 for k in range(len(fr))])), np.full(len(fr), silent / (runs + 1e-10)), columns[1], *kernels.chroma_change(fr, FS).T], 1)
    assert np.allclose([r.v for r in got if r.file == "long"], want)
    assert all(r.v[4] is None for r in got if r.file == "mid")


def test_chroma_of_a_tone():
    fs = 16_000
    c = kernels.chroma(np.sin(2 * np.pi * 440 * np.arange(1600) / fs)[None], fs)[0]
    assert c.argmax() == 27 and c.max() == 1  # A is nine semitones, 27 thirds, above C
    v = kernels.chroma_change(np.sin(2 * np.pi * 440 * np.arange(1600) / fs)[None], fs)[0]
    assert v[0] == pytest.approx(sum((c[k] - c[k + 1 if k < 35 else 1]) ** 2 for k in range(36)))
    spectrum = [abs(sum(c[m] * np.exp(-2j * np.pi * k * m / 72) for m in range(36))) ** 2 for k in range(6, 18)]
    assert v[1] == pytest.approx(sum(spectrum))


def test_dither_is_seeded():
    x = np.zeros(1000)
    assert (kernels.dithered(x, 1) == kernels.dithered(x, 1)).all() and (kernels.dithered(x, 1) != kernels.dithered(x, 2)).any()
    assert 0 < np.abs(kernels.dithered(x, 1)).max() <= 2**-15
