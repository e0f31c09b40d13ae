"""Patches of frames as arrays, labelled and scored, and the scores of a file put together over feature families.

Frames are rows (file, i, v), v a vector, i from 0 on without gaps; waves are frames of one element. A patch is a list of vectors. A frame meets its patches by an equality join on
(file, i), so a long file is spread over its frames. Null files are left out. An empty table gives no patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import written

from .patches import finite, tiled_rows
from .split import standard_scaled

#: Characters of the grams by which names meet.
SHORT = 8


def lengths_of(frames: DataFrame) -> DataFrame:
    """(file, n): how many frames a file has."""
    return frames.where("file is not null").groupBy("file").agg((F.max("i") + 1).cast("long").alias("n"))


def scaled_frames(frames: DataFrame, size: int) -> DataFrame:
    """(file, i, v): finite frames, scaled by file and element, those of files shorter than ``size`` repeated whole until they're longer."""
    kept = finite(frames.where("file is not null"))
    scaled = standard_scaled(kept, ["file", "i"], ["file"], "v").join(lengths_of(kept), "file")
    return tiled_rows(scaled.withColumnRenamed("z", "v"), size).select("file", "i", "v")


def scaled_wave(frames: DataFrame, size: int) -> DataFrame:
    """(file, i, v) of rows (file, i, x): waves less their mean, over the distance of their extremes, repeated as ``scaled_frames``; constant waves are 0."""
    known = frames.where("file is not null and x is not null")
    sums = known.groupBy("file").agg(F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("reach"), F.count("*").alias("n"))
    x = F.coalesce(F.try_divide(F.col("x") - F.col("mean"), "reach"), F.lit(0.0))
    return tiled_rows(known.join(sums, "file").select("file", "i", F.array(x).alias("v"), sums["n"]), size).select("file", "i", "v")


def random_starts(lengths: DataFrame, size: int, step: int, seed: int = 1) -> DataFrame:
    """(file, patch, start): ceil(n / step) full patches a file at starts that the hash of seed, file and patch draws, repeats allowed; no row for files shorter than size."""
    many = F.ceil(F.col("n") / step).cast("long")
    patches = lengths.where(F.col("n") >= size).withColumn("patch", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return patches.select("file", "patch", F.pmod(F.xxhash64(F.lit(seed), "file", "patch"), F.col("n") - size + 1).alias("start"))


def centred_starts(lengths: DataFrame, size: int, step: int) -> DataFrame:
    """(file, patch, start): patches of 2 * (size // 2) frames around frames 0, step, 2 * step ...; the first ones begin before the file."""
    many = F.ceil(F.col("n") / step).cast("long")
    patches = lengths.where("n > 0").withColumn("patch", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return patches.select("file", "patch", (F.col("patch") * step - size // 2).alias("start"))


def patch_arrays(frames: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(file, patch, m array<array<double>>) of each patch's ``width`` frames from start on; frames that the file hasn't are zeros."""
    places = starts.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("i", F.col("start") + F.col("place"))
    vector = F.col("v").cast("array<double>")
    met = places.join(frames.select("file", "i", vector.alias("v")), ["file", "i"], "left")
    lists = met.groupBy("file", "patch").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("s"), F.max(F.size("v")).alias("d"))
    none = F.array_repeat(F.lit(0.0), F.col("d"))
    return lists.select("file", "patch", F.transform("s.v", lambda v: F.coalesce(v, none)).alias("m"))


def random_patches(frames: DataFrame, size: int, step: int, seed: int = 1, pick: list[int] | None = None) -> DataFrame:
    """(file, patch, m): patches of scaled frames at random starts, of the elements ``pick``, by default all."""
    scaled = scaled_frames(frames, size)
    out = patch_arrays(scaled, random_starts(lengths_of(scaled), size, step, seed), size)
    return out if pick is None else out.withColumn("m", F.transform("m", lambda v: F.array(*(F.get(v, k) for k in pick))))


def wave_patches(waves: DataFrame, size: int, step: int, seed: int = 1) -> DataFrame:
    """(file, patch, m array<double>): stretches of ``size`` samples of scaled waves (file, i, x) at random starts."""
    scaled = scaled_wave(waves, size)
    return patch_arrays(scaled, random_starts(lengths_of(scaled), size, step, seed), size).withColumn("m", F.flatten("m"))


def centred_patches(frames: DataFrame, size: int, step: int) -> DataFrame:
    """(file, patch, m): patches of scaled frames around every step-th frame, zeros beyond the file."""
    scaled = written(scaled_frames(frames, size), "scaled")  # read for the lengths and for the patches
    return patch_arrays(scaled, centred_starts(lengths_of(scaled), size, step), 2 * (size // 2))


def labelled_patches(patches: DataFrame, labels: DataFrame, step: int) -> DataFrame:
    """patches with y, the label (file, i, y) of frame patch * step; patches beyond the labels go."""
    marks = labels.where(F.col("i") % step == 0).select("file", (F.col("i") / step).cast("long").alias("patch"), "y")
    return patches.join(marks, ["file", "patch"])


def fused_scores(scores: DataFrame, order: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(file, patch, p, ...): the scores (file, feat, patch, p) of several feature families added up and divided by their number.

    A file's patches are those of its first family in ``order``; a shorter family gets copies of its own last patches (its first one again, where it's shorter than what it lacks), a longer one is cut.
    Families that aren't in order don't count; a family that a file lacks adds 0. With labels (file, patch, ...) what has none is cut, and their columns are kept.
    """
    known = scores.where(F.col("feat").isin(order) & F.col("file").isNotNull())
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("feat"))
    sizes = known.groupBy("file", "feat").agg((F.max("patch") + 1).alias("m"))
    wanted = sizes.groupBy("file").agg(F.min_by("m", rank).alias("n"))
    lack = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    places = sizes.join(wanted, "file").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    places = places.select("file", "feat", "to", F.when(F.col("to") < F.col("m"), F.col("to")).otherwise(F.greatest(F.col("to") - lack, F.lit(0))).alias("patch"))
    long = places.join(known, ["file", "feat", "patch"]).select("file", F.col("to").alias("patch"), F.posexplode("p").alias("c", "s"))
    sums = long.groupBy("file", "patch", "c").agg((F.sum("s") / len(order)).alias("s"))
    out = sums.groupBy("file", "patch").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("k")).select("file", "patch", F.col("k.s").alias("p"))
    return out if labels is None else out.join(labels, ["file", "patch"])


def named_match(files: DataFrame, predictions: DataFrame, suffix: str = "") -> DataFrame:
    """(file, prediction): the prediction (column name) whose name contains the file's name and ``suffix``; of several the shortest, then the least name.

    Every name is cut into its grams of SHORT characters, or fewer for names shorter than that, so that names meet by equality on a gram: a file's rarest one among the predictions'
    names, so hot grams match little. Nulls and empty names match nothing; repeated names count once.
    """
    one = files.where("file is not null and file != ''").select("file").distinct().withColumn("f", F.concat("file", F.lit(suffix)))
    two = predictions.where("name is not null").select("name").distinct()
    widths = one.select(F.least(F.length("f"), F.lit(SHORT)).alias("w")).distinct()  # SHORT rows at most

    def grams(column: str, width: Column) -> Column:
        return F.when(F.length(column) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - width + 1), lambda k: F.substring(F.col(column), k, width)))).otherwise(F.array().cast("array<string>"))

    there = two.join(F.broadcast(widths)).select("name", "w", F.explode(grams("name", F.col("w"))).alias("g"))
    often = there.groupBy("w", "g").agg(F.count("*").alias("n"))
    wanted = one.withColumn("w", F.least(F.length("f"), F.lit(SHORT))).select("file", "f", "w", F.explode(grams("f", F.col("w"))).alias("g"))
    # A gram that no prediction has rules a match out.
    rarest = wanted.join(often, ["w", "g"], "left").groupBy("file", "f", "w").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    met = rarest.join(there, ["w", "g"]).where(F.contains(F.col("name"), F.col("f")))
    return met.groupBy("file").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("prediction"))
