"""Spectral, source and phase features of signals.

Work is dealt by the smallest piece that decides a value: frames for spectra, blocks of frames where a value is scaled or
filtered over its block, whole waves only for filters and transforms that run along all of one. Frames come from rows of samples
(``frames_of``: a hot file is spread over its frames) or from waves held as arrays (``frames_of_waves``: no shuffle).

Null samples count as 0; waves that are null or shorter than a frame, and empty tables, give no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import kernels

from .sequence import framed, silence_ratio

#: name -> kernel (frames, fs) -> frames x values.
FRAMES = {
    "spectral_shape": kernels.spectral_shape,
    "melspectrogram": kernels.mel_power,
    "log_mel": kernels.log_mel,
    "log_mel_sum": kernels.log_mel_sum,
    "peak_scaled": kernels.peak_scaled,
    "chroma": kernels.chroma,
    "chroma_change": kernels.chroma_change,
    "zero_crossings": kernels.zero_crossings,
    "energy": kernels.energy,
    "mean": kernels.mean,
    "autocorrelation_peak": kernels.autocorrelation_peak,
    "hngd": kernels.hngd,
    "hngdmfcc": kernels.hngd_cepstra,
}

#: name -> kernel (frames of a block, fs, hop) -> frames x values.
BLOCKS = {"mgdcc": kernels.modified_group_delay, "ifcc": kernels.instantaneous_frequency}

#: name -> kernel (wave, fs, size, hop) -> a sample for each sample.
WAVES = {
    "zero_frequency": kernels.zero_frequency_wave,
    "residual": kernels.residual,
    "residual_envelope": kernels.residual_envelope,
    "sidelobe_ratio": kernels.sidelobe_ratio,
    "modulation_4hz": kernels.modulation_wave,
}

#: Frames of a block.
BLOCK = 100
#: Frames of short blocks that a kernel takes at once.
FEW = 2_000
#: Samples that a kernel of frames takes at once, of one frame at least: some kernels need a hundred times the memory of their samples.
SAMPLES = 32_768


def frames_of(seq: DataFrame, size: int, hop: int) -> DataFrame:
    """(file, frame, samples) of rows (file, i, x, n)."""
    filled = seq.select("file", "i", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), "n")
    rows = framed(filled, size, hop).groupBy("file", "frame").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return rows.select("file", "frame", F.col("s.x").alias("samples"))


def waves_of(seq: DataFrame) -> DataFrame:
    """(file, samples) of rows (file, i, x, n): for what needs whole waves, which then must fit a task."""
    x = F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")
    return seq.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", x))).alias("s")).select("file", F.col("s.x").alias("samples"))


def frames_of_waves(waves: DataFrame, size: int, hop: int, columns: tuple[str, ...] = ("samples",)) -> DataFrame:
    """(file, frame, columns...) of waves whose arrays ``columns`` are of one length."""
    whole = waves.select("file", *columns).where(F.size(columns[0]) >= size)
    last = F.floor((F.size(columns[0]) - size) / hop).cast("long")
    each = whole.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = lambda c: F.transform(F.slice(c, (F.col("frame") * hop + 1).cast("int"), F.lit(size)), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    return each.select("file", "frame", *(part(c).alias(c) for c in columns))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(rows, float).ravel()))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SAMPLES samples of frames."""
    for batch in batches:
        lists = batch[column]
        step = max(1, SAMPLES * len(lists) // max(1, len(lists.flatten())))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_frame(frames: DataFrame, parts: list[tuple[str, str]], fs: float, **settings) -> DataFrame:
    """(file, frame, v): values of FRAMES, each of a column of frames, one after another."""
    kind = frames.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, parts[0][1]):
            if batch.num_rows:
                v = np.concatenate([FRAMES[name](_matrix(batch[column]), fs, **settings) for name, column in parts], 1)
                yield pa.RecordBatch.from_arrays([batch["file"], batch["frame"], _lists(v)], names=["file", "frame", "v"])

    return frames.mapInArrow(run, f"file {kind}, frame long, v array<double>")


def _blocks(frames: DataFrame, block: int) -> DataFrame:
    """(file, first, frames): consecutive frames' samples, one after another, in order."""
    rows = frames.groupBy("file", F.floor(F.col("frame") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("frame", "samples"))).alias("f"))
    return rows.select("file", F.element_at("f.frame", 1).alias("first"), F.col("f.samples").alias("frames"))


def _block_rows(frames: DataFrame, block: int, kernel: Callable) -> DataFrame:
    """(setting, file, frame, v) of a kernel that takes several blocks' frames and gives (setting, values of all these frames) for each of its settings.

    Blocks go through the kernel about FEW frames at a time, however short they are.
    """
    kind = frames.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["frames"].value_lengths().to_numpy(zero_copy_only=False).astype(int)
            before = np.cumsum(sizes) - sizes
            cuts = np.flatnonzero(np.diff(before // FEW, prepend=-1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows]):
                some = batch.slice(s, e - s)
                row = np.repeat(np.arange(e - s), sizes[s:e])
                file = some["file"].take(pa.array(row))
                frame = pa.array(some["first"].to_numpy()[row] + np.arange(len(row)) - (before[s:e] - before[s])[row])
                for number, v in kernel(np.split(_matrix(some["frames"].flatten()), (before[s:e] - before[s])[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), number, np.int32)), file, frame, _lists(v)], names=["setting", "file", "frame", "v"])

    return _blocks(frames, block).mapInArrow(run, f"setting int, file {kind}, frame long, v array<double>")


#: Columns of ``group_delays``.
DELAYS = ("ngd", "mag", "gd", "mgd", "dngd", "hngd", "dgd", "hgd")


def group_delays(frames: DataFrame, fs: float) -> DataFrame:
    """(file, frame, ngd, mag, gd, mgd, dngd, hngd, dgd, hgd) of frames (file, frame, samples): see ``kernels.delay_family``."""
    kind = frames.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "samples"):
            if batch.num_rows:
                found = kernels.delay_family(_matrix(batch["samples"]), fs)
                yield pa.RecordBatch.from_arrays([batch["file"], batch["frame"], *(_lists(found[k]) for k in DELAYS)], names=["file", "frame", *DELAYS])

    return frames.select("file", "frame", "samples").mapInArrow(run, f"file {kind}, frame long, " + ", ".join(f"{k} array<double>" for k in DELAYS))


def by_block(frames: DataFrame, family: str, fs: float, hop: int, block: int = BLOCK, **settings) -> DataFrame:
    """(file, frame, v): values of BLOCKS; block: frames that share a scale or a transform, which changes results."""
    return _block_rows(frames, block, lambda xs: [(0, np.concatenate([BLOCKS[family](x, fs, hop, **settings) for x in xs]))]).drop("setting")


def swept(frames: DataFrame, rhos: list[float], gammas: list[float], block: int = BLOCK) -> DataFrame:
    """Modified group delay cepstra under each rho and gamma, in one scan: (rho, gamma, file, frame, v)."""
    grid = [(float(rho), float(gamma)) for rho in rhos for gamma in gammas]
    rows = _block_rows(frames, block, lambda xs: kernels.modified_group_delays(xs, grid))
    pick = lambda k: F.element_at(F.array(*(F.lit(g[k]) for g in grid)), F.col("setting") + 1)
    return rows.select(pick(0).alias("rho"), pick(1).alias("gamma"), "file", "frame", "v")


def with_series(waves: DataFrame, families: list[str], fs: float, size: int, hop: int) -> DataFrame:
    """(file, samples, families...): values of WAVES beside the samples, as arrays of the same length."""
    kind = waves.schema["file"].dataType.simpleString()
    whole = waves.where("samples is not null").select("file", F.transform("samples", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch["samples"][row].values.to_numpy(zero_copy_only=False)
                found = [WAVES[f](x, fs, size, hop) if len(x) else x for f in families]
                yield pa.RecordBatch.from_arrays([batch["file"].slice(row, 1), batch["samples"].slice(row, 1), *(_lists(v[None]) for v in found)], names=["file", "samples", *families])

    return whole.mapInArrow(run, f"file {kind}, samples array<double>, " + ", ".join(f"{f} array<double>" for f in families))


def _sum_of(a: Column, b: Column, f: Callable) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda t, x: t + x)


def _flux(spectrum: Column) -> Column:
    """Squared change of an array from that of the frame before; 0 for the first."""
    before = F.lag(spectrum).over(Window.partitionBy("file").orderBy("frame"))
    return F.coalesce(_sum_of(spectrum, before, lambda x, y: (x - y) * (x - y)), F.lit(0.0))


def spectral_flux(frames: DataFrame, fs: float) -> DataFrame:
    """(file, frame, flux) of spectra over their peak."""
    return by_frame(frames, [("peak_scaled", "samples")], fs).select("file", "frame", _flux(F.col("v")).alias("flux"))


def mfcc(frames: DataFrame, fs: float, bands: int = kernels.BANDS, n: int = kernels.CEPSTRA, depth: float = 80.0) -> DataFrame:
    """(file, frame, v): cosine coefficients of log_mel, which is cut ``depth`` decibels below the file's largest value."""
    logs = by_frame(frames, [("log_mel", "samples")], fs, bands=bands)
    floor = F.max(F.array_max("v")).over(Window.partitionBy("file")) - depth
    cut = logs.withColumn("__f", floor).withColumn("v", F.transform("v", lambda x: F.greatest(x, F.col("__f"))))
    basis = F.array(*(F.array(*map(F.lit, map(float, row))) for row in kernels.cosines(bands, n)))
    return cut.select("file", "frame", F.transform(basis, lambda row: _sum_of(row, F.col("v"), lambda x, y: x * y)).alias("v"))


def slopes(features: DataFrame, width: int = 9, column: str = "v") -> DataFrame:
    """features with d: least-squares slope of an array over an odd number of frames, at the ends that of the first and last such.

    Files with fewer frames than ``width`` take the largest odd number that fits; with fewer than three the values themselves.
    """
    reach = width // 2
    by = Window.partitionBy("file").orderBy("frame")
    h = F.least(F.lit(reach), F.floor((F.count("*").over(Window.partitionBy("file")) - 1) / 2)).cast("int")
    near = F.collect_list(F.struct("frame", F.col(column).alias("v"))).over(by.rowsBetween(-2 * reach, 2 * reach))
    n = F.count("*").over(Window.partitionBy("file"))
    centre = F.greatest(h.cast("long"), F.least(n - 1 - h, F.col("frame")))
    seen = features.withColumns({"__near": near, "__h": h, "__c": centre})
    inside = F.filter("__near", lambda p: F.abs(p["frame"] - F.col("__c")) <= F.col("__h"))
    zero = F.transform(column, lambda v: F.lit(0.0))
    total = F.aggregate(inside, zero, lambda t, p: F.zip_with(t, p["v"], lambda a, x: a + (p["frame"] - F.col("__c")) * x))
    scale = F.col("__h") * (F.col("__h") + 1) * (2 * F.col("__h") + 1) / 3
    return seen.withColumn("d", F.when(F.col("__h") > 0, F.transform(total, lambda v: v / scale)).otherwise(F.col(column))).drop("__near", "__h", "__c")


def with_slopes(features: DataFrame, width: int = 9) -> DataFrame:
    """(file, frame, v): the values, their slopes, and the slopes' slopes."""
    first = slopes(features.select("file", "frame", "v"), width).withColumnRenamed("d", "__d")
    return slopes(first, width, "__d").select("file", "frame", F.concat("v", "__d", "d").alias("v"))


def epochs(series: DataFrame, fs: float, part: float = 0.7) -> DataFrame:
    """(file, i, strength, f0, voiced) at upward zero crossings of the filtered wave z of (file, i, z).

    i is the sample before the crossing; strength is the step from i - 1 to i + 1 over the file's largest, f0 the rate over the
    distance to the next epoch, at the last one that of the one before (null if it's alone); voiced: strength above ``part`` of the mean.
    """
    by, whole = Window.partitionBy("file").orderBy("i"), Window.partitionBy("file")
    z, after, before = F.col("z"), F.lead("z").over(by), F.lag("z").over(by)
    steps = series.select("file", "i", "z", after.alias("a"), before.alias("b")).where("z <= 0 and a > 0 and b is not null")
    found = steps.withColumn("s", F.abs(F.col("a") - F.col("b"))).withColumn("f0", fs / (F.lead("i").over(by) - F.col("i")))
    scaled = found.withColumn("strength", F.col("s") / (F.max("s").over(whole) + kernels.TINY)).withColumn("f0", F.coalesce("f0", F.lag("f0").over(by)))
    return scaled.select("file", "i", "strength", "f0", (F.col("strength") > part * F.avg("strength").over(whole)).alias("voiced"))


def _at(k: int) -> Column:
    return F.element_at("v", k)


def source_features(waves: DataFrame, fs: float, size: int, hop: int) -> DataFrame:
    """(file, frame, v of 10): first peak of the filtered wave's autocorrelation, means of the 4 Hz modulation and of the peak-to-sidelobe
    ratio, zero crossings, energy, log mel energy, centroid, flux, rolloff, and the file's share of low-energy frames.

    Waves are read once; the only exchange is the one by file that flux and share need.
    """
    series = with_series(waves, ["zero_frequency", "modulation_4hz", "sidelobe_ratio"], fs, size, hop)
    frames = frames_of_waves(series, size, hop, ("samples", "zero_frequency", "modulation_4hz", "sidelobe_ratio"))
    parts = [("autocorrelation_peak", "zero_frequency"), ("mean", "modulation_4hz"), ("mean", "sidelobe_ratio")]
    parts += [(name, "samples") for name in ("zero_crossings", "energy", "log_mel_sum", "spectral_shape", "peak_scaled")]
    whole = Window.partitionBy("file")
    rows = by_frame(frames, parts, fs).withColumn("flux", _flux(F.slice("v", 11, size))).withColumn("__e", F.avg(_at(7)).over(whole))
    low = F.avg((_at(7) < 0.5 * F.col("__e")).cast("double")).over(whole)
    return rows.select("file", "frame", F.array(*map(_at, (1, 4, 5, 6, 7, 8, 9)), F.col("flux"), _at(10), low).alias("v"))


def texture_features(waves: DataFrame, marks: DataFrame, fs: float, size: int, hop: int) -> DataFrame:
    """(file, frame, v of 9): root mean square, zero crossings, centroid, flux, silence ratio and frequency of the file's marks
    (file, frame, m), mean of the 4 Hz modulation, and the two chroma_change values. Files without marks have null ratios.
    """
    frames = frames_of_waves(with_series(waves, ["modulation_4hz"], fs, size, hop), size, hop, ("samples", "modulation_4hz"))
    parts = [("energy", "samples"), ("zero_crossings", "samples"), ("spectral_shape", "samples"), ("mean", "modulation_4hz"), ("chroma_change", "samples"), ("peak_scaled", "samples")]
    rows = by_frame(frames, parts, fs).withColumn("flux", _flux(F.slice("v", 8, size))).join(silence_ratio(marks, "frame"), "file", "left")
    return rows.select("file", "frame", F.array(F.sqrt(_at(1)), _at(2), _at(3), F.col("flux"), F.col("ratio"), F.col("frequency"), _at(5), _at(6), _at(7)).alias("v"))


def phase_features(frames: DataFrame, fs: float, hop: int, block: int = BLOCK) -> DataFrame:
    """(file, frame, hngd, mgd, ifc): the three cepstra with their slopes."""
    found = with_slopes(by_frame(frames, [("hngdmfcc", "samples")], fs)).withColumnRenamed("v", "hngd")
    for name, family in (("mgd", "mgdcc"), ("ifc", "ifcc")):
        found = found.join(with_slopes(by_block(frames, family, fs, hop, block)).withColumnRenamed("v", name), ["file", "frame"])
    return found
