"""Expressions on feature arrays and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def finite(column: Column | str) -> Column:
    """No element is NaN or infinite."""
    return ~F.exists(_c(column), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def cepstral_subset(column: Column | str) -> Column:
    """The first 7 of 13 cepstra, of their slopes and of the slopes of these."""
    return F.concat(*(F.slice(_c(column), 1 + 13 * k, 7) for k in range(3)))


def summary_subset(column: Column | str) -> Column:
    """cepstral_subset of means and of variances, 39 each."""
    return F.concat(*(F.slice(_c(column), 1 + 13 * k, 7) for k in range(6)))


def without_last_of_halves(column: Column | str) -> Column:
    half = F.size(_c(column)) / 2
    return F.concat(F.slice(_c(column), F.lit(1), half.cast("int") - 1), F.slice(_c(column), half.cast("int") + 1, half.cast("int") - 1))


def zero_padded(column: Column | str, size: int) -> Column:
    return F.concat(_c(column), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(_c(column))))


def repeated(column: Column | str, times: int) -> Column:
    """Each element times times."""
    return F.flatten(F.transform(_c(column), lambda v: F.array_repeat(v, times)))


def mel10(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hz10(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def mel_e(hz: Column) -> Column:
    return 1127 * F.log(1 + hz / 700)


def hz_e(mel: Column) -> Column:
    return 700 * (F.exp(mel / 1127) - 1)


def next_power_of_2(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("int")


def stem(path: Column | str) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(F.substring_index(_c(path), "/", -1), ".", 1)


def named_value(pair: Column) -> Column:
    """name and value of ``name:value``."""
    parts = F.split(pair, ":", 2)
    return F.struct(F.get(parts, 0).alias("name"), F.get(parts, 1).alias("value"))


def steps_per_epoch(hours: Column, shift: Column, batch: int) -> Column:
    return F.floor(hours * 3.6e6 / shift * 0.66 * 0.7 / (2 * batch)).cast("int")
