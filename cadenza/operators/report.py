"""Reports over files: segmentation by class and tolerance, recognition by noise level; and the noisy signals these are made from.

Labels are rows (file, i, n, ...), i from 0 on. Files without events count nothing; empty tables give empty reports. Null labels are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.kernels import mixed

from .metrics import event_rates, masked_other, matched_by_reference, tolerance_frames
from .sequence import median_filter, mode_filter, rolled


#: Waves that meet one copy of a noise.
WAVES = 256


def smoothed_scores(scores: DataFrame, width: int) -> DataFrame:
    """(file, i, n, speech, music) of music scores x in rows (file, i, x, n), median-filtered; at 0.5 both are 0."""
    y = F.col("y")
    rows = median_filter(scores, width) if width else scores.withColumn("y", F.col("x"))
    return rows.select("file", "i", "n", (1 - y > y).cast("int").alias("speech"), (1 - y < y).cast("int").alias("music"))


def smoothed_labels(labels: DataFrame, width: int) -> DataFrame:
    """(file, i, n, speech, music) of speech labels m in rows (file, i, m, n), mode-filtered; music is the rest."""
    rows = mode_filter(labels, width) if width else labels.withColumn("y", F.col("m"))
    return rows.select("file", "i", "n", F.col("y").alias("speech"), (1 - F.col("y")).alias("music"))


def shifted_labels(labels: DataFrame, by: int) -> DataFrame:
    """As smoothed_labels, but rolled by so many places instead."""
    return rolled(labels, by).select("file", "i", "n", F.col("m").alias("speech"), (1 - F.col("m")).alias("music"))


def segmentation_report(ref: DataFrame, est: DataFrame, tolerances: list[int], offsets: bool = False) -> DataFrame:
    """event_rates by tolerance (milliseconds, frames of 10) and class, and by tolerance alone.

    ref, est: (file, i, n, speech, music), ref below 0 where neither class is meant: such places are 0 on both sides. Events are rises,
    with offsets also falls. Each file's tolerance is so many frames as its length asks for; an event meets others in buckets of that.
    """
    wide = lambda rows, name: rows.select("file", "i", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), F.coalesce(c, F.lit(0)).alias(name)) for c in ("speech", "music")))).alias("k")).select("file", "i", "n", "k.*")
    both = masked_other(wide(ref, "y").join(wide(est, "p").drop("n"), ["file", "cls", "i"]))
    by = Window.partitionBy("file", "cls").orderBy("i")
    steps = both.withColumns({c: F.col(c) - F.lag(c).over(by) for c in ("y", "p")})
    levels = F.explode(F.array(*map(F.lit, tolerances)))

    def events(c: str) -> DataFrame:
        found = steps.where(F.col(c) != 0 if offsets else F.col(c) > 0).withColumn("tolerance", levels)
        return found.select(F.struct("file", "cls", "tolerance").alias("file"), "i", tolerance_frames(F.col("tolerance"), F.col("n")).cast("long").alias("within"))

    counts = matched_by_reference(events("y"), events("p"), F.col("within"))
    return event_rates(counts.select("file.tolerance", "file.cls", "tp", "fp", "fn", "n_ref"))


def noisy(waves: DataFrame, noises: DataFrame, levels: list[float], pick: Column | None = None) -> DataFrame:
    """(file, noise, snr_db, samples): each wave with one noise, repeated to its length, at each level; without its mean, over its peak.

    waves: (file, samples); noises: (noise, samples). The noise is that whose place among all names is ``pick`` (by default a hash of
    file) modulo their number, so the same in each run. Only the names are numbered in one place; samples meet in a join by noise.
    Waves and noises that are null or empty give no rows, null samples count as 0, silent noises leave the wave as it is.
    """
    sound = lambda rows: rows.where(F.size("samples") > 0).withColumn("samples", F.transform("samples", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))))
    library = sound(noises.where("noise is not null")).dropDuplicates(["noise"])
    names = library.select("noise").withColumn("__k", (F.row_number().over(Window.orderBy("noise")) - 1).cast("long")).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(1))))
    many = names.agg(F.max("__n").alias("__n"))
    numbered = sound(waves).select("file", "samples", (F.xxhash64("file") if pick is None else pick).cast("long").alias("__p")).join(F.broadcast(many))
    numbered = numbered.withColumn("__k", F.pmod("__p", "__n")).drop("__n", "__p")
    # A noise that many waves have is copied to as many tasks.
    often = numbered.groupBy("__k").agg(F.ceil(F.count("*") / WAVES).cast("int").alias("__parts"))
    shares = names.drop("__n").join(often, "__k")
    dealt = numbered.join(F.broadcast(shares), "__k").withColumn("__salt", F.pmod(F.xxhash64("file"), F.col("__parts")).cast("int")).drop("__parts", "__k")
    copies = library.select("noise", F.col("samples").alias("z")).join(F.broadcast(shares.drop("__k")), "noise").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    chosen = dealt.join(copies, ["noise", "__salt"])
    kind, name = waves.schema["file"].dataType.simpleString(), noises.schema["noise"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, z = (batch[c][row].values.to_numpy(zero_copy_only=False) for c in ("samples", "z"))
                own = batch.slice(row, 1)
                for level in levels:
                    y = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(mixed(x, z, level)))
                    yield pa.RecordBatch.from_arrays([own["file"], own["noise"], pa.array([float(level)]), y], names=["file", "noise", "snr_db", "samples"])

    return chosen.select("file", "noise", "samples", "z").mapInArrow(run, f"file {kind}, noise {name}, snr_db double, samples array<double>")
