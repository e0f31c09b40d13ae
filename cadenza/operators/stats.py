"""Statistics between feature sets, from moments that Spark merges and small dense algebra on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import written

from .moments import matrix, moments, pearson
from .ranks import running


def first_canonical(vectors: DataFrame, column: str, split: int) -> float:
    """The first canonical correlation of the elements before split and those from it on; NaN for no vectors."""
    found = moments(vectors, column)
    return float("nan") if found is None else canonical(found.cov, slice(0, split), slice(split, None))[0]


def canonical(cov: np.ndarray, one: slice, two: slice) -> tuple[float, np.ndarray, np.ndarray]:
    """The first canonical correlation of two blocks of a covariance and both blocks' weights, by which projections have variance 1.

    Directions without variance take no part; the larger weight of the first block is positive.
    """

    def root(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        keep = w > 1e-12 * max(w.max(initial=0), 0)
        return v[:, keep] / np.sqrt(w[keep]) @ v[:, keep].T

    a, b = root(cov[one, one]), root(cov[two, two])
    u, s, v = np.linalg.svd(a @ cov[one, two] @ b)
    x, y = a @ u[:, 0], b @ v[0]
    sign = np.sign(x[np.abs(x).argmax()]) or 1.0
    return float(min(s[0], 1.0)), x * sign, y * sign


def canonical_pairs(vectors: DataFrame, key: str, column: str, families: dict[str, tuple[int, int]]) -> DataFrame:
    """(a, b, r, pearson, spearman) of all pairs of feature families a < b, which are ranges [begin, end) of one vector's elements.

    All pairs' weights come from one table of co-moments; r is the first canonical correlation. Both projections of every row are made in one pass,
    and pearson and spearman are those of the two projections, ranks by ``element_ranks``. Null vectors and such with null elements are left out; keys tell rows apart. No rows for no vectors.
    """
    spark = vectors.sparkSession
    found = moments(vectors, column)
    pairs = [(a, b) for a in sorted(families) for b in sorted(families) if a < b]
    kind = "a string, b string, r double, pearson double, spearman double"
    if found is None or not pairs:
        return spark.createDataFrame([], kind)
    solved = [canonical(found.cov, slice(*families[a]), slice(*families[b])) for a, b in pairs]
    weights = np.zeros((len(found.mean), 2 * len(pairs)))
    for k, ((a, b), (_, x, y)) in enumerate(zip(pairs, solved)):
        weights[slice(*families[a]), 2 * k], weights[slice(*families[b]), 2 * k + 1] = x, y
    shared = spark.sparkContext.broadcast((found.mean, weights))  # as many numbers as a vector has elements, for each pair twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, weights = shared.value
        for batch in batches:
            z = (matrix(batch.column(1)) - mean) @ weights if batch.num_rows else np.zeros((0, weights.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * weights.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "z"])

    v = F.col("v")
    source = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (F.size(v) > 0))
    projections = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, z array<double>")
    projections = written(projections, "projections")
    ranked = element_ranks(projections, "id", "z")
    values = [pearson(rows, c).where("b = a + 1 and a % 2 = 0").select((F.col("a") / 2).cast("int").alias("k"), F.col("r").alias(name)) for rows, c, name in ((projections, "z", "pearson"), (ranked, "ranks", "spearman"))]
    named = spark.createDataFrame([(k, a, b, r) for k, ((a, b), (r, _, _)) in enumerate(zip(pairs, solved))], "k int, a string, b string, r double")
    return named.join(values[0], "k").join(values[1], "k").drop("k")


def element_ranks(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ranks array<double>): each element's average rank among the same element of all vectors, from 1 on.

    Values are counted first, and the counts are summed along the values by ``ranks.running``, so no task holds an element's values. Vectors must be of one length;
    null vectors and such with null elements are left out. Keys tell rows apart.
    """
    v = F.col("v")
    source = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    long = source.select("id", F.posexplode("v").alias("d", "v"))
    values = long.groupBy("d", "v").agg(F.count("*").alias("n"))
    placed = running(values, ["d"], ["v"], "before", "all", "n").select("d", "v", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    lists = long.join(placed, ["d", "v"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "rank"))).alias("r"))
    return lists.select(F.col("id").alias(key), F.col("r.rank").alias("ranks"))


def spearman_all(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(a, b, r) of the average ranks of all pairs of elements a < b of an array column; null where an element is constant."""
    return pearson(element_ranks(vectors, key, column), "ranks")


def manova(vectors: DataFrame, column: str, label: str) -> dict[str, float]:
    """Wilks, Pillai, Hotelling-Lawley and Roy for features against the label alone, without intercept; NaN for no vectors or labels of 0."""
    joined = vectors.select(F.concat(F.col(column).cast("array<double>"), F.array(F.col(label).cast("double"))).alias("v"))
    found = moments(joined, "v")
    xx = np.zeros((1, 1)) if found is None else found.m + found.n * np.outer(found.mean, found.mean)
    if not xx[-1, -1]:
        return dict.fromkeys(("wilks", "pillai", "hotelling", "roy"), float("nan"))
    yy, yx, s = xx[:-1, :-1], xx[:-1, -1], xx[-1, -1]
    b = yx / s
    e = yy - s * np.outer(b, b)
    lam = float(s * b @ np.linalg.pinv(e) @ b)
    return {"wilks": 1 / (1 + lam), "pillai": lam / (1 + lam), "hotelling": lam, "roy": lam}


def pearson_pairs(long: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, r) of elements a < b, of rows (id, d, v)."""
    left, right = long.select("id", F.col("d").alias("a"), F.col("v").alias("x")), long.select("id", F.col("d").alias("b"), F.col("v").alias("y"))
    chosen = F.lit(False)
    for a, b in pairs:
        chosen = chosen | ((F.col("a") == a) & (F.col("b") == b))
    return left.join(right, "id").where(chosen).groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def zca(vectors: DataFrame, column: str, epsilon: float = 1e-5) -> np.ndarray:
    """The whitening matrix U (S + epsilon)^-1/2 U' of a column's covariance."""
    u, s, _ = np.linalg.svd(moments(vectors, column).cov)
    return u @ np.diag(1 / np.sqrt(s + epsilon)) @ u.T


def principal(vectors: DataFrame, column: str, part: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the fewest principal axes (columns) that hold part of the variance; a ValueError for no vectors."""
    found = moments(vectors, column)
    if found is None:
        raise ValueError("no vectors")
    w, v = np.linalg.eigh(found.cov)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), part - 1e-12)) + 1
    return found.mean, v[:, : min(k, len(w))]


def projected(vectors: DataFrame, column: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """vectors with z: column less the mean, on the axes. Null vectors and such with null elements give null."""
    shared = vectors.sparkSession.sparkContext.broadcast((mean, axes))  # a number for each element and axis
    v = F.col(column).cast("array<double>")
    source = vectors.withColumn("z", F.when(~F.exists(v, lambda x: x.isNull()), v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            x = (matrix(own.drop_null()) - mean) @ axes if own.null_count < len(own) else np.zeros((0, axes.shape[1]))
            ends = np.concatenate([[0], np.cumsum(own.is_valid().to_numpy(zero_copy_only=False))]) * axes.shape[1]
            z = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel()), mask=own.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], names=batch.schema.names)

    return source.mapInArrow(run, source.schema)
