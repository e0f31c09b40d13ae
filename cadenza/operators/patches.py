"""Patches of frames: vectors scaled by file, short files tiled, a grid of patches, one row of summaries each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import fresh
from .sequence import patch_grid


def finite(frames: DataFrame) -> DataFrame:
    """Frames (file, i, v) without those that have a null, NaN or infinite element, numbered anew in their order."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return frames.where(F.col("v").isNotNull() & ~bad).withColumn("i", (F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1).cast("long"))


def scaled_elements(frames: DataFrame, scaled: bool = True) -> DataFrame:
    """(file, i, d, x, n): elements of v less their file's mean over their population deviation; constant ones are 0. Without ``scaled`` they stay as they are.

    Moments are sums by file and element, joined back: no window holds a file.
    """
    long = frames.select("file", "i", F.posexplode("v").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    moments = long.groupBy("file", "d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("m"), "s"), F.lit(0.0))
    return long.join(moments, ["file", "d"]).select("file", "i", "d", (z if scaled else F.col("x")).alias("x"), "n")


def tiled_rows(seq: DataFrame, size: int) -> DataFrame:
    """Sequences (file, i, ..., n) shorter than size, repeated whole until they are longer."""
    times = F.when(F.col("n") < size, F.floor(F.lit(size) / F.col("n")) + 1).otherwise(1).cast("long")
    turn, = fresh(seq.columns, "turn")
    rows = seq.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return rows.withColumns({"i": F.col("i") + F.col(turn) * F.col("n"), "n": F.col("n") * times}).drop(turn)


def patch_summaries(frames: DataFrame, size: int, step: int, keep: list[int] | None = None, scaled: bool = True) -> DataFrame:
    """(file, patch, v): means, then population variances, of the elements (those in keep, by default all) over each patch.

    frames: (file, i, v) with i from 0 on. Elements are scaled by file, unless told otherwise. Frames that aren't finite go first; files that have none left give no row.
    """
    elements = tiled_rows(scaled_elements(finite(frames), scaled), size)
    if keep is not None:
        elements = elements.where(F.col("d").isin(keep))
    each = patch_grid(elements.withColumn("file", F.struct("file", "d")), size, step)
    by_d = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("file.d", c))), lambda s: s[c])
    return each.groupBy(F.col("file.file").alias("file"), "patch").agg(F.concat(by_d("mean"), by_d("var")).alias("v"))
