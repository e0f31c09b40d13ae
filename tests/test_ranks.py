"""Moments, ranks and what is built on them, against numpy and plain Python."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import moments, ranks, split, stats


def vectors_of(spark, x, parts=7):
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(-1, None), (-2, []), (-3, [None] * x.shape[1])]
    return spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(parts)


@pytest.mark.parametrize("mean", [0.0, 1e8])
def test_moments_far_from_zero(spark, mean):
    """Deviation 1 around a large mean: nothing cancels."""
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) + mean
    x[:, 5] = mean + 0.1  # constant
    df = vectors_of(spark, x)
    found = moments.moments(df, "v")
    assert found.n == 500 and np.allclose(found.mean, x.mean(0), rtol=1e-13)
    assert np.allclose(found.cov, np.cov(x.T, bias=True), rtol=0, atol=1e-6 if mean else 1e-12)
    want = np.corrcoef((x - x.mean(0))[:, :5].T)
    got = {(q.a, q.b): q.r for q in stats.pearson(df, "v").collect()}
    assert len(got) == 15 and all(got[a, 5] is None for a in range(5))
    assert max(abs(got[a, b] - want[a, b]) for a in range(5) for b in range(a + 1, 5)) < 1e-9
    centred = x[:, :5] - x[:, :5].mean(0)
    w, v = np.linalg.eigh(centred.T @ centred / 500)
    centre, axes = stats.principal(df.withColumn("v", F.slice("v", 1, 5)), "v", 0.9999999)
    assert axes.shape == (5, 5) and np.abs(np.abs((axes * v[:, ::-1]).sum(0)) - 1).max() < 1e-9
    a, b = np.linalg.qr(centred[:, :2])[0], np.linalg.qr(centred[:, 2:])[0]
    assert abs(stats.first_canonical(df.withColumn("v", F.slice("v", 1, 5)), "v", 2) - np.linalg.svd(a.T @ b, compute_uv=False)[0]) < 1e-9


def test_moments_of_none_and_of_ragged_vectors(spark):
    assert moments.moments(spark.createDataFrame([], "v array<double>"), "v") is None
    with pytest.raises(Exception, match="vectors of 2 and of 4 elements"):
        moments.moments(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],)], "v array<double>").coalesce(1), "v")
    with pytest.raises(Exception, match="elements"):
        moments.moments(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>").repartition(2), "v")
    one = moments.moments(spark.createDataFrame([([3.0, 4.0],)], "v array<float>"), "v")
    assert one.n == 1 and not one.m.any()


def test_canonical_pairs_of_three_families(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 2))
    x = np.concatenate([base @ r.normal(size=(2, 3)) + r.normal(size=(400, 3)), base @ r.normal(size=(2, 4)) + r.normal(size=(400, 4)), r.normal(size=(400, 2))], axis=1) + 1e6
    families = {"mel": (0, 3), "ifcc": (3, 7), "zcr": (7, 9)}
    rows = {(q.a, q.b): q for q in stats.canonical_pairs(vectors_of(spark, x), "id", "v", families).collect()}
    assert set(rows) == {("ifcc", "mel"), ("ifcc", "zcr"), ("mel", "zcr")}
    c = x - x.mean(0)
    for (a, b), q in rows.items():
        one, two = c[:, slice(*families[a])], c[:, slice(*families[b])]
        u, s, v = np.linalg.svd(np.linalg.qr(one)[0].T @ np.linalg.qr(two)[0])
        assert abs(q.r - s[0]) < 1e-8 and abs(q.pearson - s[0]) < 1e-6
        p, t = np.linalg.qr(one)[0] @ u[:, 0], np.linalg.qr(two)[0] @ v[0]
        order = lambda z: z.argsort().argsort()
        assert abs(q.spearman - np.corrcoef(order(p), order(t))[0, 1]) < 1e-6
    assert stats.canonical_pairs(vectors_of(spark, x).limit(0), "id", "v", families).count() == 0


def test_spearman_with_ties_and_constants(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 6, (200, 4)).astype(float)
    x[:, 3] = 2
    got = {(q.a, q.b): q.r for q in stats.spearman_all(vectors_of(spark, x), "id", "v").collect()}
    mean_rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    z = [mean_rank(x[:, k]) for k in range(3)]
    assert all(abs(got[a, b] - np.corrcoef(z[a], z[b])[0, 1]) < 1e-12 for a in range(3) for b in range(a + 1, 3)) and got[0, 3] is None


def ranked_rows(spark, many=500):
    """One class has most rows; nulls in the group, the order and the weight, and columns with the names used inside."""
    r = np.random.default_rng(4)
    rows = [(["hot", "hot", "hot", "a", None][int(r.integers(5))], k, int(r.integers(4)) if k % 9 else None, f"x{k}") for k in range(many)]
    return spark.createDataFrame(rows, "cls string, k long, w int, part string").repartition(5)


def test_running_sums_in_every_group(spark):
    df = ranked_rows(spark)
    rows = df.collect()
    for weight in (None, "w"):
        for down in (False, True):
            got = ranks.running(df, ["cls"], [F.desc("k") if down else "k"], "before", "total", weight)
            assert got.columns == ["cls", "k", "w", "part", "before", "total"]
            sums, expected = collections.Counter(), {}
            for q in sorted(rows, key=lambda q: q.k, reverse=down):
                expected[q.k] = sums[q.cls]
                sums[q.cls] += 1 if weight is None else q.w or 0
            assert {q.k: (q.before, q.total) for q in got.collect()} == {q.k: (expected[q.k], sums[q.cls]) for q in rows}
    none = ranks.running(df, [], ["k"], "before", "total")
    assert {(q.k, q.before, q.total) for q in none.collect()} == {(k, k, 500) for k in range(500)}
    assert ranks.running(df.limit(0), ["cls"], ["k"], "before", "total").collect() == []


def test_a_large_class_lies_in_many_parts(spark, tmp_path):
    """No window sorts a class's rows: the one there is runs over a row for each group and part."""
    df = spark.range(4_000).select(F.lit("only").alias("cls"), F.col("id").alias("file"))
    out = ranks.running(df, ["cls"], ["file"], "before", "total")
    path = next(line for line in out.inputFiles())
    assert spark.read.parquet(path.rpartition("/")[0]).groupBy(F.spark_partition_id(), F.input_file_name()).count().count() == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Window") :]
    assert "HashAggregate" in above[: above.index("FileScan")]
    folds = split.kfold(df, 4, ["file"]).groupBy("fold").count().collect()
    assert {(q.fold, q["count"]) for q in folds} == {(k, 1000) for k in range(4)}


def test_splits_by_place(spark):
    df = ranked_rows(spark, 60).select("cls", F.col("k").alias("file"), "part", F.lit("x").alias("place"))
    rows = sorted(df.collect(), key=lambda q: q.file)
    by = collections.defaultdict(list)
    for q in rows:
        by[q.cls].append(q.file)
    chunk = {c: -(-len(f) // 4) for c, f in by.items()}
    assert {(q.cls, q.file, q.fold) for q in split.kfold(df, 4, ["file"]).collect()} == {(c, x, k // chunk[c]) for c, f in by.items() for k, x in enumerate(f)}
    assert {(q.file, q.role) for q in split.train_val(df, ["file"]).collect()} == {(x, "train" if k < int(0.7 * len(f)) else "val") for c, f in by.items() for k, x in enumerate(f)}
    got = split.class_balanced(df.withColumn("__r", F.lit(1)), ["file"], 20)
    assert "__r" in got.columns
    assert {(q.cls, q.slot, q.file) for q in got.collect()} == {(c, s, f[s % len(f)]) for c, f in by.items() for s in range(20)}
    drawn = [split.kfold(df, 4, ranks.shuffled(seed, "file")).orderBy("cls", "file").collect() for seed in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2]
