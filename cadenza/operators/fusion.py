"""Late fusion of the scores of several feature families: rows (key, feat, p array<double>).

Null scores are left out of sums and means, a null array gives nothing; a null key is a key, but ``complete`` leaves it out. Repeated rows count as often as they stand there. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import argmax_label


def complete(scores: DataFrame, key: list[str], families: int) -> DataFrame:
    """Rows of the keys that all families have: an n-way inner join as one grouping."""
    whole = scores.groupBy(*key).agg(F.count_distinct("feat").alias("__n")).where(F.col("__n") == families)
    return scores.join(whole.drop("__n"), key, "left_semi")


def majority_vote(votes: DataFrame, key: list[str]) -> DataFrame:
    """(key, label) of rows (key, feat, p int): the most frequent, the smallest among equals."""
    counts = votes.groupBy(*key, "p").agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.max_by("p", F.struct("n", -F.col("p"))).alias("label"))


def _fused(scores: DataFrame, key: list[str], how) -> DataFrame:
    long = scores.select(*key, F.posexplode("p").alias("c", "s"))
    classes = long.groupBy(*key, "c").agg(how("s").alias("s"))
    return classes.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "s"))), lambda x: x["s"]).alias("p"))


def score_sum(scores: DataFrame, key: list[str]) -> DataFrame:
    """(key, p, label): scores summed by class, and the first largest."""
    return _fused(scores, key, F.sum).withColumn("label", argmax_label("p"))


def score_mean(scores: DataFrame, key: list[str]) -> DataFrame:
    """(key, p, label): scores averaged by class, and the first largest."""
    return _fused(scores, key, F.avg).withColumn("label", argmax_label("p"))
