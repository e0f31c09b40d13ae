"""Agreement of labels and of events.

``confusion`` counts nulls as labels of their own; scores of fixed labels count a null as none of them. Rows count as often as they stand there. Scores of nothing are null, or 0 where that's said; empty
tables give no rows where scores are by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import fresh


def confusion(rows: DataFrame) -> DataFrame:
    """(y, p, n) counts of truth y and prediction p."""
    return rows.groupBy("y", "p").agg(F.count("*").alias("n"))


def f1_scores(rows: DataFrame, labels: list[int]) -> DataFrame:
    """(label, f1) of fixed labels, 0 where undefined, and label -1: their mean rounded to 4 places."""
    table = confusion(rows)
    sums = [F.struct(F.lit(k).alias("label"), *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (("tp", (F.col("y") == k) & (F.col("p") == k)), ("y", F.col("y") == k), ("p", F.col("p") == k)))) for k in labels]
    scores = table.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s"))
    each = scores.select("s.label", F.coalesce(F.try_divide(2.0 * F.col("s.tp"), F.col("s.y") + F.col("s.p")), F.lit(0.0)).alias("f1"))
    return each.unionByName(each.agg(F.lit(-1).alias("label"), F.round(F.avg("f1"), 4).alias("f1")))


def f1_of_labels(rows: DataFrame) -> DataFrame:
    """(label, f1) of the labels that occur as truths, 0 where undefined, and label -1: their mean rounded to 4 places.

    Rows with a null truth or prediction count for neither; an empty table has the mean alone, which is null.
    """
    table = confusion(rows.where("y is not null and p is not null"))
    zero = F.lit(0).cast("long")
    truths = table.select(F.col("y").alias("label"), F.col("n").alias("y"), zero.alias("p"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    sides = truths.unionByName(table.select(F.col("p").alias("label"), zero.alias("y"), F.col("n").alias("p"), zero.alias("tp")))
    sums = sides.groupBy("label").agg(F.sum("y").alias("y"), F.sum("p").alias("p"), F.sum("tp").alias("tp")).where("y > 0")
    each = sums.select("label", (2.0 * F.col("tp") / (F.col("y") + F.col("p"))).alias("f1"))
    return each.unionByName(each.agg(F.lit(-1).alias("label"), F.round(F.avg("f1"), 4).alias("f1")))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def segment_stats(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of class 1 and of class 0, by keys such as a noise level; null on 0 / 0."""
    keys = keys or []
    n = lambda y, p: F.count_if((F.col("y") == y) & (F.col("p") == p))
    counts = rows.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    kinds = F.array(F.struct(F.lit(1).alias("cls"), "tp", "fp", "fn"), F.struct(F.lit(0).alias("cls"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn")))
    kind, = fresh(keys, "k")
    each = counts.select(*keys, F.explode(kinds).alias(kind)).select(*keys, f"{kind}.*")
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    scored = each.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
    return scored.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matched_by_reference(ref: DataFrame, est: DataFrame, tolerance: int | Column) -> DataFrame:
    """(file, n_ref, n_est, tp, fn, fp): a reference event counts if an estimate lies within tolerance; fp can be negative.

    Events meet in buckets of tolerance + 1 places, never pair by pair. A column as tolerance must be the same on both sides of a file.
    """
    reach = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    place = F.floor(F.col("i") / (reach + 1))
    near = est.select("file", F.col("i").alias("e"), F.explode(F.array(*(place + d for d in (-1, 0, 1)))).alias("b"))
    bucketed = ref.select("file", F.col("i").alias("r"), reach.alias("t"), place.alias("b"))
    hit = bucketed.join(near, ["file", "b"]).where(F.abs(F.col("r") - F.col("e")) <= F.col("t")).select("file", "r").distinct().groupBy("file").agg(F.count("*").alias("tp"))
    a, b = ref.groupBy("file").agg(F.count("*").alias("n_ref")), est.groupBy("file").agg(F.count("*").alias("n_est"))
    return _rates(a.join(b, "file", "full").join(hit, "file", "left"))


def matched_greedily(ref: DataFrame, est: DataFrame, tolerance: int) -> DataFrame:
    """As above, but each estimate takes the first reference event within tolerance: tp is the number of those taken."""
    width = tolerance + 1
    near = ref.select("file", F.col("i").alias("r"), F.explode(F.array(*(F.floor(F.col("i") / width) + d for d in (-1, 0, 1)))).alias("b"))
    bucketed = est.select("file", F.col("i").alias("e"), F.floor(F.col("i") / width).alias("b"))
    first = bucketed.join(near, ["file", "b"]).where(F.abs(F.col("r") - F.col("e")) <= tolerance).groupBy("file", "e").agg(F.min("r").alias("r"))
    hit = first.groupBy("file").agg(F.count_distinct("r").alias("tp"))
    a, b = ref.groupBy("file").agg(F.count("*").alias("n_ref")), est.groupBy("file").agg(F.count("*").alias("n_est"))
    return _rates(a.join(b, "file", "full").join(hit, "file", "left"))


def _rates(rows: DataFrame) -> DataFrame:
    filled = rows.na.fill(0, ["n_ref", "n_est", "tp"])
    return filled.withColumns({"fn": F.col("n_ref") - F.col("tp"), "fp": F.col("n_est") - F.col("tp")})


def event_rates(counts: DataFrame) -> DataFrame:
    """Pooled by (tolerance, cls) and by tolerance: precision, recall, f1, deletion, insertion and error rates."""
    pooled = counts.groupingSets([["tolerance", "cls"], ["tolerance"]], "tolerance", "cls").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("n_ref").alias("n")
    )
    over = lambda a, b: F.col(a) / (b + F.lit(1e-10))
    p, r = over("tp", F.col("tp") + F.col("fp")), over("tp", F.col("tp") + F.col("fn"))
    rated = pooled.withColumns({"precision": p, "recall": r, "deletion": over("fn", F.col("n")), "insertion": over("fp", F.col("n"))})
    return rated.withColumns({"f1": 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10), "error": F.col("deletion") + F.col("insertion")})


def masked_other(rows: DataFrame) -> DataFrame:
    """Where the reference is below 0 both labels become 0."""
    other = F.col("y") < 0
    return rows.withColumns({"p": F.when(other, 0).otherwise(F.col("p")), "y": F.when(other, 0).otherwise(F.col("y"))})


def fold_summary(scores: DataFrame, value: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def argmax_label(scores: str) -> Column:
    """Place of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def tolerance_frames(seconds: Column, n: Column) -> Column:
    """Frames of a tolerance in milliseconds for n frames of 10 ms and a tail of 15."""
    return F.ceil(seconds / (10 * n + 15) * n)


def ranked(rows: DataFrame, by: Window, value: str) -> Column:
    """Average rank: ties share the mean of their places."""
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(by.partitionBy(value)) - 1) / 2
