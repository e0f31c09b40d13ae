"""Silence: spans below an energy threshold, the signal without them, annotations on the shortened time axis.

Sequences are (file, i, x, n) as in sequence.py. Empty tables give empty results; files shorter than a frame
have no frames, so no silence, and stay whole; null samples count as no energy.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.kernels import bursts_suppressed

from .sequence import frame_energy, interval_frames, islands


def audible_frames(seq: DataFrame, size: int, hop: int, part: float) -> DataFrame:
    """(file, frame, m): m = 1 where the root mean square of the signal, less its mean and over its peak, reaches part of the largest.

    Marks of 20 frames and more on both sides of which few are set are cleared, one after another, each seeing
    what was cleared before: that recursion runs by file, over one number a frame.
    """
    whole = Window.partitionBy("file")
    centred = seq.withColumn("c", F.coalesce(F.col("x") - F.avg("x").over(whole), F.lit(0.0)))
    scaled = centred.withColumn("x", F.coalesce(F.try_divide("c", F.max(F.abs("c")).over(whole)), F.lit(0.0)))
    rms = frame_energy(scaled, size, hop)
    marks = rms.select("file", "frame", (F.col("rms") >= part * F.max("rms").over(whole)).cast("int").alias("m"))

    def cleared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        return rows.assign(m=bursts_suppressed(rows["m"].to_numpy()))

    return marks.groupBy("file").applyInPandas(cleared, marks.schema)


def silences(marks: DataFrame, lengths: DataFrame, size: int, hop: int, fs: float, least: float) -> DataFrame:
    """(file, first, end): samples [first, end) of silent runs of frames, if longer than ``least`` seconds.

    marks: audible_frames; lengths: (file, n). A run of frames a..b spans from frame a - 1's end to that of frame b, or, where it
    is the file's last, of frame b - 1; the first sample is never silent.
    """
    last = marks.groupBy("file").agg(F.max("frame").alias("f"))
    runs = islands(marks, "frame").where("m = 0").join(last, "file").join(lengths, "file")
    after = F.least(F.col("last") + 1, F.col("f"))
    first = F.greatest(hop * (F.col("first") - 1) + size, F.lit(1))
    end = F.least(hop * (after - 1) + size, F.col("n"))
    return runs.select("file", first.cast("long").alias("first"), end.cast("long").alias("end")).where((F.col("end") - F.col("first")) / fs > least)


def lengths_of(seq: DataFrame) -> DataFrame:
    return seq.groupBy("file").agg(F.max("n").alias("n"))


def silence_removed(seq: DataFrame, size: int, hop: int, fs: float, part: float = 0.05, least: float = 0.1, drop_tail: bool = False) -> DataFrame:
    """(file, i, x, n) without silent samples, numbered anew; drop_tail: what follows a file's last silence goes too.

    The silent spans travel along the file's samples in one sort: no row stands for a silent sample. Rows without a file are left out.
    """
    seq = seq.where("file is not null")
    spans = silences(audible_frames(seq, size, hop, part), lengths_of(seq), size, hop, fs, least)
    points = seq.select("file", "i", "x", "n", F.lit(1).alias("own"), *(F.lit(None).cast("long").alias(c) for c in ("first", "end")))
    begins = spans.select("file", F.col("first").cast("long").alias("i"), F.lit(None).cast(seq.schema["x"].dataType).alias("x"), F.lit(None).cast(seq.schema["n"].dataType).alias("n"), F.lit(0).alias("own"), F.col("first").cast("long"), F.col("end").cast("long"))
    whole = Window.partitionBy("file")
    so_far = whole.orderBy("i", "own").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end") - F.col("first")
    along = points.union(begins).select("file", "i", "x", "n", "own", F.last("end", True).over(so_far).alias("over"), F.coalesce(F.sum(length).over(so_far), F.lit(0)).alias("gone"), F.coalesce(F.sum(length).over(whole), F.lit(0)).alias("all"), F.max("end").over(whole).alias("tail"))
    kept = along.where("own = 1 and (over is null or i >= over)")
    left = F.col("n")
    if drop_tail:
        kept, left = kept.where("tail is null or i < tail"), F.coalesce("tail", "n")
    return kept.select("file", (F.col("i") - F.col("gone")).cast("long").alias("i"), "x", (left - F.col("all")).cast("long").alias("n"))


def _with_silence_before(rows: DataFrame, spans: DataFrame, at: Column, name: str) -> DataFrame:
    """rows with the length of all silence (file, t0, t1; disjoint) before the time ``at``: one sort by file, no pairs."""
    points = rows.withColumns({"__t": at, "__own": F.lit(1)})
    both = points.unionByName(spans.select("file", F.col("t0").alias("__t"), F.lit(0).alias("__own"), F.col("t0").alias("__a"), F.col("t1").alias("__b")), allowMissingColumns=True)
    by = Window.partitionBy("file").orderBy("__t", "__own").rowsBetween(Window.unboundedPreceding, 0)
    length = F.coalesce(F.sum(F.col("__b") - F.col("__a")).over(by), F.lit(0.0))
    over = F.greatest(F.coalesce(F.last("__b", True).over(by) - F.col("__t"), F.lit(0.0)), F.lit(0.0))
    return both.withColumn(name, length - over).where("__own = 1").drop("__t", "__own", "__a", "__b")


def silence_shifted(intervals: DataFrame, spans: DataFrame) -> DataFrame:
    """Annotations (file, t0, dur, cls) on the time axis without the silences (file, t0, t1), which are disjoint.

    A time moves by the silence before it, whichever way silence and annotation overlap; annotations that lie in
    silence go. Rows with a null time go, repeated ones stay.
    """
    own = intervals.select("file", "t0", "dur", "cls").where("t0 is not null and dur is not null")
    one = _with_silence_before(own, spans, F.col("t0"), "a")
    two = _with_silence_before(one, spans, F.col("t0") + F.col("dur"), "b")
    moved = two.select("file", (F.col("t0") - F.col("a")).alias("t0"), (F.col("dur") - F.col("b") + F.col("a")).alias("dur"), "cls")
    return moved.where("dur > 0")


def annotation_markers(seq: DataFrame, intervals: DataFrame, size: int, hop: int, fs: float, part: float = 0.025, least: float = 0.0, frame_hop: int | None = None) -> DataFrame:
    """(file, cls, i): frames of the signal without silence that annotations (file, t0, dur, cls; seconds) cover.

    Frames are ``frame_hop`` samples each, hop by default.
    """
    spans = silences(audible_frames(seq, size, hop, part), lengths_of(seq), size, hop, fs, least)
    silent = spans.groupBy("file").agg(F.sum(F.col("end") - F.col("first")).alias("gone"))
    rest = lengths_of(seq).join(silent, "file", "left").withColumn("left", F.col("n") - F.coalesce("gone", F.lit(0)))
    lengths = rest.select("file", (F.col("left") / fs).alias("seconds"), F.floor(F.col("left") / (frame_hop or hop)).alias("n")).where("n > 0")
    shifted = silence_shifted(intervals, spans.select("file", (F.col("first") / fs).alias("t0"), (F.col("end") / fs).alias("t1")))
    return interval_frames(shifted, lengths)


def long_enough(seq: DataFrame, fs: float, seconds: float) -> DataFrame:
    """The sequences of at least that many seconds."""
    return seq.where(F.col("n") / fs >= seconds)
