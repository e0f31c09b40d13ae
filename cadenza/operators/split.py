"""Splits, scaling and balancing.

Places in a class are exact and need no task for a class (``ranks.running``); rows that the order doesn't tell apart are placed as they come. A null class is a class. Null vectors give no elements and a null
scaled vector; null elements are left out of means and deviations, and give 0. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import fresh, running


def kfold(files: DataFrame, k: int, order: list[Column | str]) -> DataFrame:
    """(cls, file, fold): each class's files in order (``ranks.shuffled`` draws one), cut into chunks of ceil(n / k). A null class is a class."""
    placed = running(files, ["cls"], order, *(names := fresh(files.columns, "place", "many")))
    place, many = map(F.col, names)
    return placed.select("cls", "file", F.floor(place / F.ceil(many / k)).cast("int").alias("fold"))


def train_test(folds: DataFrame, k: int) -> DataFrame:
    """A row for each file and round 0..k-1: role test in its own fold's round, else train."""
    rounds = folds.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rounds.withColumn("role", F.when(F.col("fold") == F.col("round"), "test").otherwise("train"))


def train_val(rows: DataFrame, order: list[str], part: float = 0.7) -> DataFrame:
    """Within each class the first int(part * n) rows are train, the others val. A null class is a class."""
    place, many = fresh(rows.columns, "place", "many")
    placed = running(rows, ["cls"], order, place, many)
    return placed.withColumn("role", F.when(F.col(place) < F.floor(part * F.col(many)), "train").otherwise("val")).drop(place, many)


def unpivoted(vectors: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row (keys, d, v) for each element of an array column."""
    return vectors.select(*keys, F.posexplode(column).alias("d", "v"))


def standard_scaled(vectors: DataFrame, keys: list[str], group: list[str], column: str, fit: Column | None = None) -> DataFrame:
    """keys and z: column scaled by the mean and population deviation of each element; constant ones give 0.

    Statistics are over each group, and over the rows where fit holds, if given. Sums are taken before the shuffle.
    """
    long = unpivoted(vectors if fit is None else vectors.where(fit), group, column)
    stats = long.groupBy(*group, "d").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    lists = stats.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("d", "mean", "std"))).alias("__s"))
    joined = vectors.join(F.broadcast(lists)) if not group else vectors.join(lists, group)
    scaled = F.zip_with(F.col(column), F.col("__s"), lambda v, s: F.coalesce(F.try_divide(v.cast("double") - s["mean"], s["std"]), F.lit(0.0)))
    return joined.select(*keys, scaled.alias("z"))


def balanced_mean(long: DataFrame) -> DataFrame:
    """(d, mean): of rows (cls, d, v) the mean of the classes' means."""
    return long.groupBy("cls", "d").agg(F.avg("v").alias("m")).groupBy("d").agg(F.avg("m").alias("mean"))


def mean_deviation(long: DataFrame) -> DataFrame:
    """(d, mean_dev, std): the sum of x - balanced mean over n - 1, never squared, and the sample deviation."""
    joined = long.join(balanced_mean(long), "d")
    return joined.groupBy("d").agg((F.sum(F.col("v") - F.col("mean")) / (F.count("*") - 1)).alias("mean_dev"), F.stddev_samp("v").alias("std"))


def histogram(rows: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(cls, bin, share): counts of v in equal bins of [low, high], over the class's count; high is in the last bin."""
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / (high - low) * bins)).cast("int")
    counts = rows.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("cls", at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("cls", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("cls"))).alias("share"))


def class_balanced(rows: DataFrame, order: list[str], per_class: int) -> DataFrame:
    """per_class rows of each class in order, round again when it has fewer: (cls, slot, ...). A null class is a class."""
    place, many = fresh(rows.columns, "place", "many")
    ranked = running(rows, ["cls"], order, place, many).where(F.col(place) < per_class)
    slots = F.sequence(F.col(place).cast("int"), F.lit(per_class - 1), F.col(many).cast("int"))
    return ranked.withColumn("slot", F.explode(slots)).drop(place, many)


def zipped_to_shorter(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a and b at the same place in order within each file; what has no partner is cut, and so are rows without a file."""
    left, right = (running(rows.where("file is not null"), ["file"], order, "place", "many").drop("many") for rows in (a, b))
    return left.join(right.drop(*order), ["file", "place"])
