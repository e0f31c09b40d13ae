"""What the operators on sequences, scores and labels do with nulls, ties, repeated rows and empty tables."""

import math

from cadenza.operators import fusion, metrics, sequence, split


def test_frames_of_null_samples_and_files(spark):
    rows = [("a", 0, 1.0, 4), ("a", 1, None, 4), ("a", 2, 3.0, 4), ("a", 2, 3.0, 4), ("a", 3, None, 4)] + [(None, k, 2.0, 2) for k in range(2)] + [("b", k, None, 2) for k in range(2)]
    seq = spark.createDataFrame(rows, "file string, i long, x double, n long")
    got = {(q.file, q.frame): (q.mean, q.var) for q in sequence.frame_mean_var(seq, 2, 2).collect()}
    assert got == {("a", 0): (1.0, 0.0), ("a", 1): (3.0, 0.0), (None, 0): (2.0, 0.0), ("b", 0): (None, None)}
    got = {(q.file, q.frame): q.energy for q in sequence.frame_energy(seq, 2, 2).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 9.0, (None, 0): 4.0, ("b", 0): None}
    marks = spark.createDataFrame([(None, 0, 1), (None, 1, 1), (None, 2, 0), ("a", 0, 0)], "file string, i long, m int")
    assert {(q.file, q.m, q.first, q.last) for q in sequence.islands(marks).collect()} == {(None, 1, 0, 1), (None, 0, 2, 2), ("a", 0, 0, 0)}
    lengths = spark.createDataFrame([(None, 4.0, 4), ("a", 4.0, 4)], "file string, seconds double, n long")
    spans = spark.createDataFrame([(None, 0.0, 1.0, "s"), ("a", 0.5, 1.0, "s"), ("b", 0.0, 1.0, "s")], "file string, t0 double, dur double, cls string")
    assert {(q.file, q.i) for q in sequence.interval_frames(spans, lengths).collect()} == {("a", 0), ("a", 1), ("a", 2)}


def test_empty_sequences(spark):
    none = spark.createDataFrame([], "file string, i long, x double, n long")
    marks = spark.createDataFrame([], "file string, i long, m int, n long")
    for out in (sequence.frame_mean_var(none, 2, 1), sequence.frame_zcr(none, 2, 1), sequence.median_filter(none, 3), sequence.transition_track(none, 2), sequence.context(none, 1), sequence.islands(marks), sequence.mode_filter(marks, 3), sequence.silence_ratio(marks)):
        assert out.collect() == []


def test_votes_and_scores(spark):
    votes = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 2), (2, 0, 3), (2, 1, 1), (None, 0, 5)], "k int, feat int, p int")
    assert {q.k: q.label for q in fusion.majority_vote(votes, ["k"]).collect()} == {1: 2, 2: 1, None: 5}
    scores = spark.createDataFrame([(1, 0, [0.5, 0.5]), (1, 1, [None, 1.0]), (1, 1, [None, 1.0]), (2, 0, None), (3, 0, [0.5, 0.5])], "k int, feat int, p array<double>")
    got = {q.k: (q.p, q.label) for q in fusion.score_mean(scores, ["k"]).collect()}
    assert set(got) == {1, 3} and got[1][0][0] == 0.5 and math.isclose(got[1][0][1], 2.5 / 3) and got[1][1] == 1 and got[3] == ([0.5, 0.5], 0)
    assert {q.k for q in fusion.complete(scores, ["k"], 2).collect()} == {1} and fusion.score_sum(scores.limit(0), ["k"]).collect() == []


def test_labels(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 1), (1, None), (1, 1)], "y int, p int")
    assert {(q.y, q.p): q.n for q in metrics.confusion(rows).collect()} == {(1, 1): 2, (1, 0): 1, (0, 0): 1, (None, 1): 1, (1, None): 1}
    got = {q.label: q.f1 for q in metrics.f1_scores(rows, [0, 1]).collect()}
    assert got == {0: 2 / 3, 1: 4 / 7, -1: round((2 / 3 + 4 / 7) / 2, 4)}
    assert metrics.segment_stats(rows.limit(0).selectExpr("*", "1 as k"), ["k"]).collect() == []


def test_scaling_of_nulls(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, None]), (2, "a", [3.0, 5.0]), (3, "a", None), (4, None, [1.0, 1.0])], "id int, cls string, v array<double>")
    got = {q.id: q.z for q in split.standard_scaled(rows, ["id"], [], "v").collect()}
    assert got[3] is None and got[1][1] == 0.0 and got[2][1] == 1.0 and math.isclose(got[2][0], math.sqrt(2)) and set(got) == {1, 2, 3, 4}
