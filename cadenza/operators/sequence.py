"""Operators over ordered sequences: rows (file, i, x, n), i from 0 on, n the sequence's length.

What needs the neighbours of a sample in a fixed reach is written as an explode to the frames that
hold it and a grouping, which sums up before it shuffles; what runs along a whole sequence is a window
over (file, i), and all such windows of one operator share one exchange and sort.

A null file is a file like any other, but for what joins by file (``patch_centered``, ``snr_gain``, ``interval_frames``), which leaves it out. Means, variances and energies are
of the samples that aren't null; a frame of null samples alone has null ones. A repeated row counts as often as it stands there in frames. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import fresh


def _by():
    return Window.partitionBy("file").orderBy("i")


def _whole():
    return Window.partitionBy("file")


def sequence(rows: DataFrame, file: str, value: str, order: list[str]) -> DataFrame:
    """(file, i, x, n) of rows in the given order."""
    by = Window.partitionBy("file").orderBy(*order)
    named = rows.select(F.col(file).alias("file"), F.col(value).alias("x"), *order)
    return named.select("file", (F.row_number().over(by) - 1).cast("long").alias("i"), "x", F.count("*").over(_whole()).alias("n"))


def framed(seq: DataFrame, size: int, hop: int) -> DataFrame:
    """seq with a row for each full frame that holds a sample: frame f spans [f * hop, f * hop + size)."""
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / hop)).cast("long")
    last = F.least(F.floor(F.col("i") / hop), F.floor((F.col("n") - size) / hop)).cast("long")
    a, b = fresh(seq.columns, "first", "last")
    inside = seq.where(F.col("n") >= size).withColumns({a: first, b: last}).where(F.col(a) <= F.col(b))
    return inside.withColumn("frame", F.explode(F.sequence(a, b))).drop(a, b)


def frame_mean_var(seq: DataFrame, size: int, hop: int) -> DataFrame:
    return framed(seq, size, hop).groupBy("file", "frame").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def frame_energy(seq: DataFrame, size: int, hop: int) -> DataFrame:
    """Mean square and its root of each frame."""
    return framed(seq, size, hop).groupBy("file", "frame").agg(F.avg(F.col("x") * F.col("x")).alias("energy")).withColumn("rms", F.sqrt("energy"))


def frame_zcr(seq: DataFrame, size: int, hop: int) -> DataFrame:
    """Share of a frame's samples whose sign differs from that of the sample before, within the frame."""
    crossed = seq.withColumn("c", ((F.col("x") < 0) != (F.lag("x").over(_by()) < 0)).cast("int"))
    inner = framed(crossed, size, hop).withColumn("c", F.when(F.col("i") > F.col("frame") * hop, F.col("c")).otherwise(0))
    return inner.groupBy("file", "frame").agg((F.sum("c") / size).alias("zcr"))


def low_energy_share(seq: DataFrame, size: int, hop: int, part: float = 0.5) -> DataFrame:
    """Share of a file's frames with less than part of the mean energy."""
    energy = frame_energy(seq, size, hop).withColumn("mean", F.avg("energy").over(_whole()))
    return energy.groupBy("file").agg(F.avg((F.col("energy") < part * F.col("mean")).cast("double")).alias("share"))


def preemphasis(seq: DataFrame, coefficient: float = 0.97) -> DataFrame:
    """x[i] - coefficient * x[i - 1]; the first sample stays."""
    return seq.withColumn("y", F.col("x") - coefficient * F.coalesce(F.lag("x").over(_by()), F.lit(0.0)))


def patch_starts(lengths: DataFrame, size: int, step: int) -> DataFrame:
    """(file, patch, start) of patches at 0, step, 2 * step ...; those that reach over the end end at it."""
    many = F.when(F.col("n") >= size, F.ceil(F.col("n") / step)).otherwise(0)
    patches = lengths.where(many > 0).withColumn("patch", F.explode(F.sequence(F.lit(0).cast("long"), (many - 1).cast("long"))))
    return patches.select("file", "patch", F.least(F.col("patch") * step, F.col("n") - size).alias("start"))


def patch_grid(seq: DataFrame, size: int, step: int) -> DataFrame:
    """Mean and population variance of each patch of patch_starts."""
    i, n, none = F.col("i"), F.col("n"), F.array().cast("array<bigint>")
    # Regular patches that hold i by arithmetic, then, near the end, those that end at it.
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / step)).cast("long")
    last = F.least(F.floor(i / step), F.floor((n - size) / step)).cast("long")
    tail, end = (F.floor((n - size) / step) + 1).cast("long"), (F.ceil(n / step) - 1).cast("long")
    regular = F.when(first <= last, F.sequence(first, last)).otherwise(none)
    shifted = F.when((i >= n - size) & (tail <= end), F.sequence(tail, end)).otherwise(none)
    held = seq.where(n >= size).withColumn("__p", F.explode(F.concat(regular, shifted)))
    rows = held.withColumn("p", F.struct(F.col("__p").alias("patch"), F.least(F.col("__p") * step, n - size).alias("start")))
    return rows.groupBy("file", F.col("p.patch").alias("patch"), F.col("p.start").alias("start")).agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def patch_centered(seq: DataFrame, size: int, step: int, label: Column) -> DataFrame:
    """Patches around h, h + step, ... < n - h, h = size // 2, over [i - h, i + h): mean, and the label at place k * step."""
    h = size // 2
    inside = _by().rowsBetween(-h, h - 1)
    marked = seq.withColumn("label", label).withColumn("mean", F.avg("x").over(inside))
    centres = marked.where((F.col("i") >= h) & (F.col("i") < F.col("n") - h) & ((F.col("i") - h) % step == 0))
    centres = centres.select("file", ((F.col("i") - h) / step).cast("long").alias("patch"), "mean")
    labels = marked.where(F.col("i") % step == 0).select("file", (F.col("i") / step).cast("long").alias("patch"), "label")
    return centres.join(labels, ["file", "patch"])


def tiled(column: str, size: int) -> Column:
    """An array repeated whole until it is longer than size, if it was shorter."""
    n = F.size(column)
    return F.when((n > 0) & (n < size), F.flatten(F.array_repeat(column, F.floor(F.lit(size) / n).cast("int") + 1))).otherwise(F.col(column))


def silence_mask(seq: DataFrame, size: int, hop: int, part: float) -> DataFrame:
    """m = 1 for frames whose root mean square, of the signal less its mean and over its peak, exceeds part of the largest."""
    centred = seq.withColumn("c", F.col("x") - F.avg("x").over(_whole()))
    scaled = centred.withColumn("x", F.coalesce(F.try_divide("c", F.max(F.abs("c")).over(_whole())), F.lit(0.0)))
    rms = frame_energy(scaled, size, hop)
    return rms.select("file", "frame", (F.col("rms") > part * F.max("rms").over(_whole())).cast("int").alias("m"))


def islands(marks: DataFrame, index: str = "i") -> DataFrame:
    """(file, run, m, first, last) of the runs of equal m."""
    by = Window.partitionBy("file").orderBy(index)
    turn = F.coalesce((F.col("m") != F.lag("m").over(by)).cast("int"), F.lit(0))
    runs = marks.withColumn("__turn", turn).withColumn("run", F.sum("__turn").over(by))
    return runs.groupBy("file", "run", "m").agg(F.min(index).alias("first"), F.max(index).alias("last"))


def silence_ratio(marks: DataFrame, index: str = "i") -> DataFrame:
    """Share of silent places, and of silent runs among all runs (+ 1e-10)."""
    runs = islands(marks, index).withColumn("k", F.col("last") - F.col("first") + 1)
    silent = F.col("m") == 0
    sums = runs.groupBy("file").agg(F.sum(F.when(silent, F.col("k")).otherwise(0)).alias("a"), F.sum("k").alias("b"), F.count_if(silent).alias("c"), F.count("*").alias("d"))
    return sums.select("file", (F.col("a") / F.col("b")).alias("ratio"), (F.col("c") / (F.col("d") + 1e-10)).alias("frequency"))


def trend_removed(seq: DataFrame, reach: int) -> DataFrame:
    """x less its mean over [i - reach, i + reach], as far as there are samples."""
    return seq.withColumn("y", F.col("x") - F.avg("x").over(_by().rowsBetween(-reach, reach)))


def cumulated(seq: DataFrame) -> DataFrame:
    return seq.withColumn("y", F.sum("x").over(_by().rowsBetween(Window.unboundedPreceding, 0)))


def mode_filter(marks: DataFrame, width: int) -> DataFrame:
    """The more frequent of 0 and 1 in [i - h, i + h), h = width // 2 of the odd width; ties give 0, edges stay."""
    h = (width + (width % 2 == 0)) // 2
    ones = F.sum("m").over(_by().rowsBetween(-h, h - 1))
    return marks.withColumn("y", F.when((F.col("i") >= h) & (F.col("i") < F.col("n") - h), (2 * ones > 2 * h).cast("int")).otherwise(F.col("m")))


def median_filter(seq: DataFrame, width: int) -> DataFrame:
    """Median over an odd width; beyond the ends there are zeros."""
    h = width // 2
    around = F.collect_list("x").over(_by().rowsBetween(-h, h))
    padded = F.sort_array(F.concat(around, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(around))))
    return seq.withColumn("y", F.element_at(padded, h + 1))


def onsets(marks: DataFrame) -> DataFrame:
    """onoff: m differs from the mark before; onset: it has risen."""
    step = F.coalesce(F.col("m") - F.lag("m").over(_by()), F.lit(0))
    return marks.withColumns({"onoff": F.abs(step), "onset": (step > 0).cast("int")})


def rolled(seq: DataFrame, by: int) -> DataFrame:
    """The value of place i goes to place (i + by) mod n."""
    return seq.withColumn("i", F.pmod(F.col("i") + by, F.col("n")))


def context(seq: DataFrame, reach: int) -> DataFrame:
    """x of the places i - reach .. i + reach, round the ends, as an array."""
    near = F.explode(F.array(*(F.struct(F.lit(k + reach).alias("k"), F.pmod(F.col("i") - k, F.col("n")).alias("at")) for k in range(-reach, reach + 1))))
    rows = seq.withColumn("s", near)
    return rows.groupBy("file", F.col("s.at").alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("s.k", "x"))), lambda v: v["x"]).alias("around"))


def transition_track(seq: DataFrame, reach: int) -> DataFrame:
    """Bhattacharyya distance of the reach samples before i and those from i on, as normal; null where one side is short.

    Distances over mean + 5 deviations of the file are set to its least.
    """
    left, right = _by().rowsBetween(-reach, -1), _by().rowsBetween(0, reach - 1)
    moments = seq.select(
        "file", "i", "n", F.avg("x").over(left).alias("a"), F.var_pop("x").over(left).alias("va"), F.avg("x").over(right).alias("b"), F.var_pop("x").over(right).alias("vb")
    )
    inside = (F.col("i") >= reach) & (F.col("i") <= F.col("n") - reach) & (F.col("va") > 0) & (F.col("vb") > 0)
    va, vb, gap = F.col("va"), F.col("vb"), F.col("a") - F.col("b")
    d = 0.25 * F.log(0.25 * (va / vb + vb / va + 2)) + 0.25 * gap * gap / (va + vb)
    found = moments.withColumn("d", F.when(inside, d))
    high = F.col("d") > F.avg("d").over(_whole()) + 5 * F.stddev_pop("d").over(_whole())
    return found.select("file", "i", F.when(high, F.min("d").over(_whole())).otherwise(F.col("d")).alias("d"))


def interval_frames(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """(file, i, cls) of the frames floor(t0 / L * n) .. ceil((t0 + dur) / L * n), cut at n - 1; L: the file's seconds."""
    joined = intervals.join(lengths, "file")
    a = F.floor(F.col("t0") / F.col("seconds") * F.col("n")).cast("long")
    b = F.least(F.ceil((F.col("t0") + F.col("dur")) / F.col("seconds") * F.col("n")), F.col("n") - 1).cast("long")
    return joined.withColumns({"__a": a, "__b": b}).where("__a <= __b").select("file", "cls", F.explode(F.sequence("__a", "__b")).alias("i"))


def snr_gain(signal: DataFrame, noise: DataFrame, levels: list[int]) -> DataFrame:
    """Gain of the noise (file -> tiled to the signal) for each level in dB: sqrt(Ex / 10^(dB/10) / En)."""
    long = noise.groupBy("file").agg(F.max("n").alias("m"))
    placed = signal.join(long, "file").withColumn("j", F.col("i") % F.col("m"))
    wrapped = placed.join(noise.select("file", F.col("i").alias("j"), F.col("x").alias("z")), ["file", "j"])
    energy = wrapped.groupBy("file").agg(F.avg(F.col("x") * F.col("x")).alias("ex"), F.avg(F.col("z") * F.col("z")).alias("en"))
    leveled = energy.withColumn("snr_db", F.explode(F.array(*map(F.lit, levels))))
    return leveled.select("file", "snr_db", F.sqrt(F.try_divide(F.col("ex") / F.pow(F.lit(10.0), F.col("snr_db") / 10), "en")).alias("gain"))


def tail_filled(short: DataFrame, n: Column) -> DataFrame:
    """Rows (file, i, x, m = own length) lengthened to n places with copies of the last n - m ones."""
    many, = fresh(short.columns, "many")
    longer = short.withColumn(many, n)
    copies = longer.where(F.col("i") >= 2 * F.col("m") - F.col(many)).where(F.col(many) > F.col("m")).withColumn("i", F.col("i") + F.col(many) - F.col("m"))
    return longer.unionByName(copies).drop(many)
