"""The queries of the library on the driver's tables, with their SQL for DuckDB.

events stands in for signals (a user's values in order of time), embeddings for labelled feature
vectors, documents and labels for files and verdicts. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.operators import balance, chunks, fusion, metrics, models, network, patches, ranks, recognition, report, sequence, signal, silence, split, stats, svm, tensors
from cadenza.sources import audio, store
from cadenza.sources.tables import shared_folder, written

SIZE, HOP = 17, 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What the SQL texts share.
WITH = {
    "s": "s as (select user_id as file, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x, count(*) over (partition by user_id) as n from events)",
    "fr": "fr as (select s.file, f.frame, s.i, s.x, s.n from s join (select distinct file, n, unnest(range(0, (n - 17) // 8 + 1)) as frame from s where n >= 17) f on s.file = f.file and s.i >= f.frame * 8 and s.i < f.frame * 8 + 17)",
    "mk": "mk as (select file, i, n, (x > 50)::int as m, (x > 60)::int as e from s)",
    "en": "en as (select file, frame, avg(x * x) as energy from fr group by all)",
    "isl": "isl as (select file, run, m, min(i) as first, max(i) as last from (select *, sum(t) over (partition by file order by i) as run from (select *, case when m <> lag(m) over (partition by file order by i) then 1 else 0 end as t from mk)) group by all)",
    "on_": "on_ as (select file, i, n, m - coalesce(lag(m) over w, m) as a, e - coalesce(lag(e) over w, e) as b from mk window w as (partition by file order by i))",
    "v": "v as (select vec_id, label, unnest(range(0, 64)) as d, unnest(embedding)::double as v from embeddings)",
    "q": "q as (select l.doc_id, l.quality as y, (d.n_chars > 800)::int as p, d.lang from labels l join documents d using (doc_id))",
    "fo": "fo as (select source as cls, doc_id as file, floor((row_number() over (partition by source order by doc_id) - 1) / ceil(count(*) over (partition by source) / 4.0))::int as fold from documents)",
    "sc": "sc as (select vec_id, label, unnest([0, 1, 2]) as feat, unnest([[abs(embedding[1])::double, abs(embedding[2])::double], [abs(embedding[3])::double, abs(embedding[4])::double], [abs(embedding[5])::double, abs(embedding[6])::double]]) as p from embeddings)",
}


def query(name: str, uses: str = "", sql: str | None = None):
    """Registers a query; uses: names of WITH in order."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = ("with " + ", ".join(WITH[u] for u in uses.split()) + " " if uses else "") + sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.sequence(table(spark, sf, "events"), "user_id", "value", ["ts", "event_id"])


def marks(spark: SparkSession, sf: str) -> DataFrame:
    return signals(spark, sf).select("file", "i", "n", (F.col("x") > 50).cast("int").alias("m"), (F.col("x") > 60).cast("int").alias("e"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return split.unpivoted(vectors(spark, sf), ["vec_id", "label"], "embedding").withColumn("v", F.col("v").cast("double"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 800).cast("int").alias("p"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three families of two scores each."""
    e = lambda k: F.abs(F.element_at("embedding", k)).cast("double")
    families = F.array(*(F.struct(F.lit(k).alias("feat"), F.array(e(2 * k + 1), e(2 * k + 2)).alias("p")) for k in range(3)))
    return vectors(spark, sf).select("vec_id", "label", F.explode(families).alias("f")).select("vec_id", "label", "f.feat", "f.p")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("frame_agreement_scores", "s fr", """, fm as (select file, frame, avg(x) as mean from fr group by all),
c as (select (mean > 50)::int as y, (mean > 45)::int as p from fm),
k as (select unnest([0, 1]) as label), t as (select label, count(*) filter (where y = label and p = label) as tp, count(*) filter (where y = label) as a, count(*) filter (where p = label) as b from c, k group by label)
select label, round(coalesce(2.0 * tp / nullif(a + b, 0), 0), 6) as f1 from t union all select -1, round(avg(coalesce(2.0 * tp / nullif(a + b, 0), 0)), 4) from t""")
def frame_agreement_scores(spark, sf):
    frames = sequence.frame_mean_var(signals(spark, sf), SIZE, HOP)
    rows = frames.select((F.col("mean") > 50).cast("int").alias("y"), (F.col("mean") > 45).cast("int").alias("p"))
    return rounded(metrics.f1_scores(rows, [0, 1]), "f1")


@query("frame_mean_var", "s fr", "select file, frame, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from fr group by all")
def frame_mean_var(spark, sf):
    return rounded(sequence.frame_mean_var(signals(spark, sf), SIZE, HOP), "mean", "var")


@query("frame_rms_energy", "s fr en", "select file, frame, round(energy, 6) as energy, round(sqrt(energy), 6) as rms from en")
def frame_rms_energy(spark, sf):
    return rounded(sequence.frame_energy(signals(spark, sf), SIZE, HOP), "energy", "rms")


@query("frame_zcr", "s", ", z as (select file, i, x - 50 as x, n from s), f as (select distinct file, n, unnest(range(0, (n - 17) // 8 + 1)) as frame from z where n >= 17), r as (select z.file, frame, z.x, lag(z.x) over (partition by z.file, frame order by z.i) as y from z join f on z.file = f.file and z.i >= frame * 8 and z.i < frame * 8 + 17) select file, frame, round(sum(case when (x < 0) <> (y < 0) then 1 else 0 end) / 17.0, 6) as zcr from r group by all")
def frame_zcr(spark, sf):
    centred = signals(spark, sf).withColumn("x", F.col("x") - 50)
    return rounded(sequence.frame_zcr(centred, SIZE, HOP), "zcr")


@query("low_energy_share", "s fr en", "select file, round(avg((energy < 0.5 * m)::int), 6) as share from (select *, avg(energy) over (partition by file) as m from en) group by file")
def low_energy_share(spark, sf):
    return rounded(sequence.low_energy_share(signals(spark, sf), SIZE, HOP), "share")


@query("preemphasis", "s", "select file, i, round(x - 0.97 * coalesce(lag(x) over (partition by file order by i), 0), 6) as y from s")
def preemphasis(spark, sf):
    return rounded(sequence.preemphasis(signals(spark, sf)).select("file", "i", "y"), "y")


@query("patch_grid", "s", ", p as (select distinct file, n, unnest(range(0, ceil(n / 8.0)::bigint)) as patch from s where n >= 17), q as (select file, patch, least(patch * 8, n - 17) as start from p) select q.file, patch, start, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from q join s on s.file = q.file and s.i >= start and s.i < start + 17 group by all")
def patch_grid(spark, sf):
    return rounded(sequence.patch_grid(signals(spark, sf), SIZE, HOP), "mean", "var")


@query("patch_centered_label", "s", ", w as (select *, avg(x) over (partition by file order by i rows between 5 preceding and 4 following) as mean from s) select a.file, (a.i - 5) // 3 as patch, round(a.mean, 6) as mean, (b.x > 50)::int as label from w a join s b on a.file = b.file and b.i = a.i - 5 where a.i >= 5 and a.i < a.n - 5 and (a.i - 5) % 3 = 0")
def patch_centered_label(spark, sf):
    return rounded(sequence.patch_centered(signals(spark, sf), 10, 3, (F.col("x") > 50).cast("int")), "mean")


@query("silence_mask", "s", ", c as (select file, i, n, x - avg(x) over (partition by file) as c from s), z as (select file, i, n, coalesce(c / nullif(max(abs(c)) over (partition by file), 0), 0) as x from c), f as (select distinct file, n, unnest(range(0, (n - 17) // 8 + 1)) as frame from z where n >= 17), r as (select z.file, frame, sqrt(avg(x * x)) as rms from z join f on z.file = f.file and z.i >= frame * 8 and z.i < frame * 8 + 17 group by all) select file, frame, (rms > 0.85 * max(rms) over (partition by file))::int as m from r")
def silence_mask(spark, sf):
    return sequence.silence_mask(signals(spark, sf), SIZE, HOP, 0.85)


@query("silence_islands", "s mk isl", "select file, run::bigint as run, m, first, last from isl")
def silence_islands(spark, sf):
    return sequence.islands(marks(spark, sf))


@query("silence_ratio_frequency", "s mk isl", "select file, round(sum(case when m = 0 then last - first + 1 else 0 end) / sum(last - first + 1), 6) as ratio, round(count(*) filter (where m = 0) / (count(*) + 1e-10), 6) as frequency from isl group by file")
def silence_ratio_frequency(spark, sf):
    return rounded(sequence.silence_ratio(marks(spark, sf)), "ratio", "frequency")


@query("moving_trend_removed", "s", "select file, i, round(x - avg(x) over (partition by file order by i rows between 3 preceding and 3 following), 6) as y from s")
def moving_trend_removed(spark, sf):
    return rounded(sequence.trend_removed(signals(spark, sf), 3).select("file", "i", "y"), "y")


@query("cumsum", "s", "select file, i, round(sum(x) over (partition by file order by i), 6) as y from s")
def cumsum(spark, sf):
    return rounded(sequence.cumulated(signals(spark, sf)).select("file", "i", "y"), "y")


@query("mode_filter", "s mk", "select file, i, case when i >= 2 and i < n - 2 then (2 * sum(m) over (partition by file order by i rows between 2 preceding and 1 following) > 4)::int else m end as y from mk")
def mode_filter(spark, sf):
    return sequence.mode_filter(marks(spark, sf), 4).select("file", "i", "y")


@query("median_filter", "s", "select file, i, round(list_sort(list_concat(w, list_resize([]::double[], 5 - len(w), 0.0)))[3], 6) as y from (select file, i, list(x) over (partition by file order by i rows between 2 preceding and 2 following) as w from s)")
def median_filter(spark, sf):
    return rounded(sequence.median_filter(signals(spark, sf), 5).select("file", "i", "y"), "y")


@query("onset_events", "s mk on_", "select file, i, abs(a) as onoff, (a > 0)::int as onset from on_")
def onset_events(spark, sf):
    return sequence.onsets(marks(spark, sf)).select("file", "i", "onoff", "onset")


@query("roll_shift", "s", "select file, ((i - 20) % n + n) % n as i, x from s")
def roll_shift(spark, sf):
    return sequence.rolled(signals(spark, sf), -20).select("file", "i", "x")


@query("ngram_context", "s", "select a.file, a.i, round(b.x, 6) as before, round(a.x, 6) as here, round(c.x, 6) as after from s a join s b on a.file = b.file and b.i = (a.i - 1 + a.n) % a.n join s c on a.file = c.file and c.i = (a.i + 1) % a.n")
def ngram_context(spark, sf):
    rows = sequence.context(signals(spark, sf), 1)
    return rows.select("file", "i", *(F.round(F.element_at("around", k + 1), 6).alias(c) for k, c in enumerate(("before", "here", "after"))))


@query("transition_track", "s", ", m as (select file, i, n, avg(x) over l as a, var_pop(x) over l as va, avg(x) over r as b, var_pop(x) over r as vb from s window l as (partition by file order by i rows between 7 preceding and 1 preceding), r as (partition by file order by i rows between current row and 6 following)), d as (select file, i, case when i >= 7 and i <= n - 7 and va > 0 and vb > 0 then 0.25 * ln(0.25 * (va / vb + vb / va + 2)) + 0.25 * (a - b) * (a - b) / (va + vb) end as d from m) select file, i, round(case when d > avg(d) over w + 5 * stddev_pop(d) over w then min(d) over w else d end, 6) as d from d window w as (partition by file)")
def transition_track(spark, sf):
    return rounded(sequence.transition_track(signals(spark, sf), 7), "d")


def _events(spark, sf):
    m = marks(spark, sf)
    at = lambda c: sequence.onsets(m.select("file", "i", "n", F.col(c).alias("m"))).where("onset = 1").select("file", "i")
    return at("m"), at("e")


_MATCH = ", r as (select file, i from on_ where a > 0), e as (select file, i from on_ where b > 0), nr as (select file, count(*) as n_ref from r group by file), ne as (select file, count(*) as n_est from e group by file)"


@query("event_match_ref", "s mk on_", _MATCH + ", h as (select file, count(*) as tp from r where exists (select 1 from e where e.file = r.file and abs(e.i - r.i) <= 1) group by file) select file, coalesce(n_ref, 0) as n_ref, coalesce(n_est, 0) as n_est, coalesce(tp, 0) as tp, coalesce(n_ref, 0) - coalesce(tp, 0) as fn, coalesce(n_est, 0) - coalesce(tp, 0) as fp from nr full join ne using (file) left join h using (file)")
def event_match_ref(spark, sf):
    return metrics.matched_by_reference(*_events(spark, sf), 1)


@query("event_match_greedy", "s mk on_", _MATCH + ", f as (select e.file, e.i, min(r.i) as r from e join r on e.file = r.file and abs(e.i - r.i) <= 1 group by all), h as (select file, count(distinct r) as tp from f group by file) select file, coalesce(n_ref, 0) as n_ref, coalesce(n_est, 0) as n_est, coalesce(tp, 0) as tp, coalesce(n_ref, 0) - coalesce(tp, 0) as fn, coalesce(n_est, 0) - coalesce(tp, 0) as fp from nr full join ne using (file) left join h using (file)")
def event_match_greedy(spark, sf):
    return metrics.matched_greedily(*_events(spark, sf), 1)


_RATES = ", ".join(f"(select {t} as tolerance, cls, count(*) as n, sum((exists (select 1 from ev e where e.k = 'b' and e.cls = r.cls and e.file = r.file and abs(e.i - r.i) <= {t}))::int) as tp from ev r where k = 'a' group by cls)" for t in (1, 2)).replace("), (", ") union all (")


@query("event_rates_grouping_sets", "s mk on_", f", ev as (select file, i, 'a' as k, 'speech' as cls from on_ where a > 0 union all select file, i, 'b', 'speech' from on_ where b > 0 union all select file, i, 'a', 'music' from on_ where a < 0 union all select file, i, 'b', 'music' from on_ where b < 0), c as ({_RATES}), g as (select c.tolerance, c.cls, tp::bigint as tp, n, (select count(*) from ev where k = 'b' and ev.cls = c.cls) - tp as fp, n - tp as fn from c), p as (select tolerance, cls, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(n) as n from g group by grouping sets ((tolerance, cls), (tolerance))) select tolerance, cls, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, n::bigint as n, round(tp / (tp + fp + 1e-10), 6) as precision, round(tp / (tp + fn + 1e-10), 6) as recall, round(2 * (tp / (tp + fp + 1e-10)) * (tp / (tp + fn + 1e-10)) / (tp / (tp + fp + 1e-10) + tp / (tp + fn + 1e-10) + 1e-10), 6) as f1, round(fn / (n + 1e-10), 6) as deletion, round(fp / (n + 1e-10), 6) as insertion, round(fn / (n + 1e-10) + fp / (n + 1e-10), 6) as error from p")
def event_rates_grouping_sets(spark, sf):
    m = marks(spark, sf)
    flips = F.array(*(F.struct(F.lit(cls).alias("cls"), F.lit(flip).alias("flip")) for cls, flip in (("speech", 0), ("music", 1))))
    both = m.withColumn("k", F.explode(flips)).withColumn("file", F.struct("file", "k.cls"))
    at = lambda c: sequence.onsets(both.select("file", "i", "n", F.abs(F.col(c) - F.col("k.flip")).alias("m"))).where("onset = 1").select("file", "i")
    ref, est = at("m"), at("e")
    each = [metrics.matched_by_reference(ref, est, t).select(F.lit(t).alias("tolerance"), "file.cls", "tp", "fp", "fn", "n_ref") for t in (1, 2)]
    return rounded(metrics.event_rates(each[0].unionByName(each[1])), "precision", "recall", "f1", "deletion", "insertion", "error")


@query("interval_to_frames", "s mk isl", ", l as (select distinct file, n, n * 0.5 as seconds from s), k as (select file, m, first * 0.5 as t0, (last - first + 1) * 0.5 as dur from isl where m = 1) select file, 's' as cls, unnest(range(floor(t0 / seconds * n)::bigint, least(ceil((t0 + dur) / seconds * n)::bigint, n - 1) + 1)) as i from k join l using (file)")
def interval_to_frames(spark, sf):
    runs = sequence.islands(marks(spark, sf)).where("m = 1")
    intervals = runs.select("file", (F.col("first") * 0.5).alias("t0"), ((F.col("last") - F.col("first") + 1) * 0.5).alias("dur"), F.lit("s").alias("cls"))
    lengths = table(spark, sf, "events").groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("n")).withColumn("seconds", F.col("n") * 0.5)
    return sequence.interval_frames(intervals, lengths)


@query("confusion", "q", "select y, p, count(*) as n from q group by all")
def confusion(spark, sf):
    return metrics.confusion(verdicts(spark, sf))


@query("f1_scores", "q", ", k as (select unnest([0, 1]) as label), t as (select label, count(*) filter (where y = label and p = label) as tp, count(*) filter (where y = label) as a, count(*) filter (where p = label) as b from q, k group by label) select label, round(coalesce(2.0 * tp / nullif(a + b, 0), 0), 6) as f1 from t union all select -1, round(avg(coalesce(2.0 * tp / nullif(a + b, 0), 0)), 4) from t")
def f1_scores(spark, sf):
    return rounded(metrics.f1_scores(verdicts(spark, sf), [0, 1]), "f1")


@query("accuracy", "q", "select round(avg((y = p)::int), 6) as accuracy from q")
def accuracy(spark, sf):
    return rounded(metrics.accuracy(verdicts(spark, sf)), "accuracy")


@query("segment_stats", "q", ", c as (select count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 0 and p = 0) as tn from q), k as (select 1 as cls, tp, fp, fn from c union all select 0, tn, fn, fp from c), r as (select *, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall from k) select cls, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) as f1 from r")
def segment_stats(spark, sf):
    return rounded(metrics.segment_stats(verdicts(spark, sf)), "precision", "recall", "f1")


def _folds(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("cls"), F.col("doc_id").alias("file"))
    return split.kfold(files, 4, ["file"])


@query("kfold_assign", "fo", "select * from fo")
def kfold_assign(spark, sf):
    return _folds(spark, sf)


@query("kfold_train_test", "fo", "select cls, file, fold, round, case when fold = round then 'test' else 'train' end as role from (select *, unnest([0, 1, 2, 3]) as round from fo)")
def kfold_train_test(spark, sf):
    return split.train_test(_folds(spark, sf), 4)


@query("train_val_split", "", "select lang as cls, doc_id, case when row_number() over (partition by lang order by doc_id) <= floor(0.7 * count(*) over (partition by lang)) then 'train' else 'val' end as role from documents")
def train_val_split(spark, sf):
    return split.train_val(table(spark, sf, "documents").select(F.col("lang").alias("cls"), "doc_id"), ["doc_id"])


@query("fold_mean_std", "fo", ", a as (select fold, avg(file) as score from fo group by fold) select round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from a")
def fold_mean_std(spark, sf):
    return rounded(metrics.fold_summary(_folds(spark, sf).groupBy("fold").agg(F.avg("file").alias("score")), "score"), "mean", "std")


@query("standard_scale", "v", "select vec_id, d, round(coalesce((v - avg(v) over w) / nullif(stddev_pop(v) over w, 0), 0), 6) as z from v window w as (partition by label, d)")
def standard_scale(spark, sf):
    z = split.standard_scaled(vectors(spark, sf), ["vec_id"], ["label"], "embedding")
    return rounded(z.select("vec_id", F.posexplode("z").alias("d", "z")).withColumn("d", F.col("d").cast("long")), "z")


@query("train_fit_scale", "v", ", t as (select d, avg(v) as m, stddev_pop(v) as s from v where vec_id % 5 < 4 group by d) select vec_id, d, round(coalesce((v - m) / nullif(s, 0), 0), 6) as z from v join t using (d)")
def train_fit_scale(spark, sf):
    z = split.standard_scaled(vectors(spark, sf), ["vec_id"], [], "embedding", F.col("vec_id") % 5 < 4)
    return rounded(z.select("vec_id", F.posexplode("z").alias("d", "z")).withColumn("d", F.col("d").cast("long")), "z")


def _classes(spark, sf):
    return elements(spark, sf).select(F.col("label").alias("cls"), F.col("d").cast("long").alias("d"), "v", F.col("vec_id").alias("id"))


@query("balanced_mean", "v", "select d, round(avg(m), 6) as mean from (select label, d, avg(v) as m from v group by all) group by d")
def balanced_mean(spark, sf):
    return rounded(split.balanced_mean(_classes(spark, sf)), "mean")


@query("mean_deviation", "v", ", b as (select d, avg(m) as m from (select label, d, avg(v) as m from v group by all) group by d) select d, round(sum(v - m) / (count(*) - 1), 6) as mean_dev, round(stddev_samp(v), 6) as std from v join b using (d) group by d")
def mean_deviation(spark, sf):
    return rounded(split.mean_deviation(_classes(spark, sf)), "mean_dev", "std")


@query("class_histogram", "v", ", h as (select label as cls, least(99, floor((v + 4.0) / 8.0 * 100))::int as bin, count(*) as n from v where v between -4 and 4 group by all) select cls, bin, round(n / sum(n) over (partition by cls), 6) as share from h")
def class_histogram(spark, sf):
    return rounded(split.histogram(_classes(spark, sf), 100, -4.0, 4.0), "share")


@query("class_balanced_sample", "", ", ".join(["with r as (select label as cls, vec_id, row_number() over (partition by label order by vec_id) - 1 as r, count(*) over (partition by label) as n from embeddings)"]) + " select cls, vec_id, unnest(range(r, 100, n))::int as slot from r where r < 100")
def class_balanced_sample(spark, sf):
    return split.class_balanced(vectors(spark, sf).select(F.col("label").alias("cls"), "vec_id"), ["vec_id"], 100)


@query("cepstral_subset", "", "select vec_id, unnest(range(0, 21)) as k, unnest(list_concat(list_concat(embedding[1:7], embedding[14:20]), embedding[27:33]))::double as v from embeddings")
def cepstral_subset(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(arrays.cepstral_subset("embedding")).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))


@query("drop_nonfinite", "", "select vec_id, count(*) as n from (select vec_id, unnest(embedding) as v from embeddings) group by all")
def drop_nonfinite(spark, sf):
    """All vectors, and beside them copies with a NaN or an infinite element, which go."""
    own = vectors(spark, sf).select("vec_id", F.col("embedding").alias("v"))
    spoilt = lambda bad: F.transform("v", lambda x, i: F.when(i == 3, F.lit(float(bad)).cast("float")).otherwise(x))
    broken = F.explode(F.array(*map(spoilt, ("nan", "inf", "-inf"))))
    rows = own.unionByName(own.select("vec_id", broken.alias("v"))).where(arrays.finite("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("n"))


@query("zero_pad", "", "select vec_id, 70::bigint as n, round(list_sum(embedding)::double, 3) as total from embeddings")
def zero_pad(spark, sf):
    padded = vectors(spark, sf).select("vec_id", arrays.zero_padded(F.transform("embedding", lambda v: v.cast("double")), 70).alias("v"))
    return padded.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda t, v: t + v), 3).alias("total"))


@query("truncate_halves", "", "select vec_id, unnest(range(0, 62)) as k, unnest(list_concat(embedding[1:31], embedding[33:63]))::double as v from embeddings")
def truncate_halves(spark, sf):
    cut = vectors(spark, sf).select("vec_id", F.posexplode(arrays.without_last_of_halves("embedding")).alias("k", "v"))
    return cut.select("vec_id", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))


@query("majority_vote", "sc", ", w as (select vec_id, (p[2] > p[1])::int as p from sc) select vec_id, (sum(p) >= 2)::int as label from w group by vec_id")
def majority_vote(spark, sf):
    votes = scores(spark, sf).withColumn("p", metrics.argmax_label("p"))
    return fusion.majority_vote(votes, ["vec_id"])


@query("score_sum_fusion", "sc", ", f as (select vec_id, sum(p[1]) as a, sum(p[2]) as b from sc group by all) select vec_id, round(a, 6) as a, round(b, 6) as b, (b > a)::int as label from f")
def score_sum_fusion(spark, sf):
    f = fusion.score_sum(fusion.complete(scores(spark, sf), ["vec_id"], 3), ["vec_id"])
    return rounded(f.select("vec_id", F.element_at("p", 1).alias("a"), F.element_at("p", 2).alias("b"), "label"), "a", "b")


@query("score_mean_fusion", "sc", ", f as (select vec_id, avg(p[1]) as a, avg(p[2]) as b from sc group by all) select vec_id, round(a, 6) as a, round(b, 6) as b, (b > a)::int as label from f")
def score_mean_fusion(spark, sf):
    f = fusion.score_mean(scores(spark, sf), ["vec_id"])
    return rounded(f.select("vec_id", F.element_at("p", 1).alias("a"), F.element_at("p", 2).alias("b"), "label"), "a", "b")


@query("missing_features_anti", "", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_features_anti(spark, sf):
    files, there = (table(spark, sf, t).select(F.col("doc_id").alias("file")) for t in ("documents", "labels"))
    return audio.missing(files, there).select(F.col("file").alias("doc_id"))


@query("available_features_semi", "", "select doc_id from documents where doc_id in (select doc_id from labels)")
def available_features_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("truncate_to_shorter", "", "with a as (select lang as file, doc_id as x, row_number() over (partition by lang order by doc_id) - 1 as place from documents), b as (select lang as file, doc_id as y, row_number() over (partition by lang order by doc_id) - 1 as place from documents where n_chars > 1000) select file, place, x, y from a join b using (file, place)")
def truncate_to_shorter(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.select(F.col("lang").alias("file"), F.col("doc_id").alias("x"), F.col("doc_id").alias("o"))
    b = docs.where("n_chars > 1000").select(F.col("lang").alias("file"), F.col("doc_id").alias("y"), F.col("doc_id").alias("o"))
    return split.zipped_to_shorter(a, b, ["o"]).select("file", "place", "x", "y").withColumn("place", F.col("place").cast("long"))


@query("fusion_tail_fill", "s", ", c as (select file, i, x, n - 6 as m, n from s where i < n - 6) select file, i, round(x, 6) as x from c union all select file, i + n - m, round(x, 6) from c where i >= 2 * m - n")
def fusion_tail_fill(spark, sf):
    short = signals(spark, sf).where("i < n - 6").withColumn("m", F.col("n") - 6)
    return rounded(sequence.tail_filled(short, F.col("n")).select("file", "i", "x"), "x")


@query("snr_mix_gain", "s", ", z as (select file, i as j, x as z, n as m from s), u as (select s.file, avg(x * x) as ex, avg(z * z) as en from s join z on z.file = (s.file + 1) and z.j = s.i % z.m group by s.file) select file, snr_db, round(sqrt(ex / pow(10.0, snr_db / 10.0) / en), 6) as gain from (select *, unnest([10, 5, 0]) as snr_db from u)")
def snr_mix_gain(spark, sf):
    s = signals(spark, sf)
    return rounded(sequence.snr_gain(s, s.withColumn("file", F.col("file") - 1), [10, 5, 0]), "gain")


@query("mel_scales", "", "select event_id, round(2595 * log10(1 + abs(value) / 700), 6) as mel10, round(1127 * ln(1 + abs(value) / 700), 6) as mel_e, round(700 * (pow(10, abs(value) / 2595) - 1), 6) as hz10 from events")
def mel_scales(spark, sf):
    v = F.abs("value")
    return rounded(table(spark, sf, "events").select("event_id", arrays.mel10(v).alias("mel10"), arrays.mel_e(v).alias("mel_e"), arrays.hz10(v).alias("hz10")), "mel10", "mel_e", "hz10")


@query("path_and_pairs", "", "select page_id, string_split(string_split(url, '/')[-1], '.')[1] as stem, string_split('id:' || page_id, ':')[2] as value from pages")
def path_and_pairs(spark, sf):
    pair = F.concat(F.lit("id:"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", arrays.stem("url").alias("stem"), arrays.named_value(pair)["value"].alias("value"))


@query("argmax_threshold", "sc", "select vec_id, feat, case when p[2] > p[1] then 1 else 0 end as arg, (p[1] > 0.5)::int as over from sc")
def argmax_threshold(spark, sf):
    return scores(spark, sf).select("vec_id", "feat", metrics.argmax_label("p").alias("arg"), (F.element_at("p", 1) > 0.5).cast("int").alias("over"))


@query("pearson_pairs", "v", "select a.d::bigint as a, b.d::bigint as b, round(corr(a.v, b.v), 6) as r from v a join v b on a.vec_id = b.vec_id and a.d < b.d group by all")
def pearson_pairs(spark, sf):
    return rounded(stats.pearson(table(spark, sf, "embeddings"), "embedding"), "r")


@query("spearman_pairs", "v", ", k as (select vec_id, d, rank() over (partition by d order by v) + (count(*) over (partition by d, v) - 1) / 2.0 as v from v) select a.d::bigint as a, b.d::bigint as b, round(corr(a.v, b.v), 6) as r from k a join k b using (vec_id) where a.d < b.d group by all")
def spearman_pairs(spark, sf):
    return rounded(stats.spearman_all(table(spark, sf, "embeddings"), "vec_id", "embedding"), "r")


@query("gaussian_nb_predict", "v", ", m as (select max(s) * 1e-9 as e from (select var_pop(v) as s from v where vec_id % 5 < 4 group by d)), g as (select label as cls, d, avg(v) as mu, var_pop(v) + (select e from m) as va from v where vec_id % 5 < 4 group by all), pr as (select label as cls, count(*) as c, sum(count(*)) over () as t from embeddings where vec_id % 5 < 4 group by label), l as (select vec_id, g.cls, ln(any_value(c) / any_value(t)) + sum(-0.5 * ln(2 * pi() * va) - (v - mu) * (v - mu) / (2 * va)) as ll from v join g using (d) join pr on pr.cls = g.cls where vec_id % 5 = 4 group by all) select vec_id, arg_max(cls, ll) as p from l group by vec_id")
def gaussian_nb_predict(spark, sf):
    rows = vectors(spark, sf)
    model = models.gaussian_fit(rows.where("vec_id % 5 < 4"), "label", "embedding")
    return models.gaussian_predict(rows.where("vec_id % 5 = 4"), model, "vec_id", "embedding").select("vec_id", F.col("label").alias("p"))


@query("hour_windows", "", "select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def hour_windows(spark, sf):
    from cadenza.streaming import windows

    return rounded4(windows.tumbling(table(spark, sf, "events"), "6 hours"))


def rounded4(df):
    return df.withColumn("total", F.round("total", 4))


#: Silent spans of the users' signals, none of which has frames enough for the burst step.
_SILENT = """, h as (select file, i, n, x - avg(x) over (partition by file) as c from s), z as (select file, i, n, coalesce(c / nullif(max(abs(c)) over (partition by file), 0), 0) as x from h),
fz as (select file, frame, sqrt(avg(x * x)) as rms from (select z.*, f.frame from z join (select distinct file, n, unnest(range(0, (n - 17) // 8 + 1)) as frame from s where n >= 17) f on z.file = f.file and z.i >= f.frame * 8 and z.i < f.frame * 8 + 17) group by all),
fm as (select file, frame, (rms >= 0.9 * max(rms) over (partition by file))::int as m from fz),
fi as (select file, m, min(frame) as a, max(frame) as b from (select *, sum(t) over (partition by file order by frame) as run from (select *, case when m <> lag(m) over (partition by file order by frame) then 1 else 0 end as t from fm)) group by file, run, m),
sp as (select * from (select file, greatest(8 * (a - 1) + 17, 1) as a, least(8 * (least(b + 1, (select max(frame) from fm where fm.file = fi.file)) - 1) + 17, (select max(n) from s where s.file = fi.file)) as b from fi where m = 0) where b - a > 0)"""


@query("silence_removed", "s", _SILENT + " select file, row_number() over (partition by file order by i) - 1 as i, x, count(*) over (partition by file) as n from s where not exists (select 1 from sp where sp.file = s.file and s.i >= sp.a and s.i < sp.b)")
def silence_removed(spark, sf):
    return silence.silence_removed(signals(spark, sf), SIZE, HOP, 1.0, 0.9, 0.0)


@query("annotation_shift", "s mk isl", _SILENT + ", k as (select file, first * 1.0 as t0, last + 1.0 as t1, m from isl where m = 1), o as (select t0, t1, k.file, coalesce(sum(greatest(least(sp.b, t0) - sp.a, 0)), 0) as u, coalesce(sum(greatest(least(sp.b, t1) - sp.a, 0)), 0) as w from k left join sp on sp.file = k.file group by all) select file, round(t0 - u, 6) as t0, round(t1 - w - t0 + u, 6) as dur, 's' as cls from o where t1 - w > t0 - u")
def annotation_shift(spark, sf):
    seq = signals(spark, sf)
    spans = silence.silences(silence.audible_frames(seq, SIZE, HOP, 0.9), silence.lengths_of(seq), SIZE, HOP, 1.0, 0.0)
    runs = sequence.islands(marks(spark, sf)).where("m = 1")
    intervals = runs.select("file", F.col("first").cast("double").alias("t0"), (F.col("last") - F.col("first") + 1).cast("double").alias("dur"), F.lit("s").alias("cls"))
    return rounded(silence.silence_shifted(intervals, spans.select("file", F.col("first").cast("double").alias("t0"), F.col("end").cast("double").alias("t1"))), "t0", "dur")


@query("f1_of_labels", "", "with q as (select label as y, (abs(embedding[1]) * 5)::int as p from embeddings), l as (select distinct y as label from q), t as (select label, count(*) filter (where y = label and p = label) as tp, count(*) filter (where y = label) as a, count(*) filter (where p = label) as b from q, l group by label) select label, round(2.0 * tp / (a + b), 6) as f1 from t union all select -1, round(avg(2.0 * tp / (a + b)), 4) from t")
def f1_of_labels(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("y"), F.rint(F.abs(F.element_at("embedding", 1)) * 5).cast("int").alias("p"))
    return rounded(metrics.f1_of_labels(rows), "f1")


@query("patch_summaries", "v", ", e as (select label as file, d, row_number() over (partition by label, d order by vec_id) - 1 as i, v, count(*) over (partition by label, d) as n, avg(v) over (partition by label, d) as mu, stddev_pop(v) over (partition by label, d) as sd from v where d in (0, 6, 13)), z as (select file, d, i, coalesce((v - mu) / nullif(sd, 0), 0) as x, n from e), t as (select file, d, i + k * n as i, x, n * r as n from (select *, unnest(range(0, r)) as k from (select *, case when n < 60 then 60 // n + 1 else 1 end as r from z))), p as (select distinct file, n, unnest(range(0, ceil(n / 20.0)::bigint)) as patch from t where n >= 60), g as (select t.file, patch, d, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from t join (select *, least(patch * 20, n - 60) as start from p) q on t.file = q.file and i >= start and i < start + 60 group by all) select file, patch, 0::bigint + d as d, mean, var from g")
def patch_summaries(spark, sf):
    frames = table(spark, sf, "embeddings").select(F.col("label").alias("file"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("i"), F.col("embedding").alias("v"))
    found = patches.patch_summaries(frames, 60, 20, [0, 6, 13])
    each = found.select("file", "patch", F.explode(F.arrays_zip(F.array(*map(F.lit, (0, 6, 13))).alias("d"), F.slice("v", 1, 3).alias("mean"), F.slice("v", 4, 3).alias("var"))).alias("k"))
    return rounded(each.select("file", "patch", F.col("k.d").cast("long").alias("d"), "k.mean", "k.var"), "mean", "var")


#: Frames of 32 samples, 16 apart, at a rate of 1000, and their spectra under a Hann window.
FS, FRAME, STEP = 1000, 32, 16
WITH |= {
    "fq": "fq as (select s.file, f.frame, i - frame * 16 as j, x from s join (select distinct file, n, unnest(range(0, (n - 32) // 16 + 1)) as frame from s where n >= 32) f on s.file = f.file and s.i >= f.frame * 16 and s.i < f.frame * 16 + 32)",
    "sp": "sp as (select file, frame, k, sqrt(power(sum(x * h * cos(pi() * k * j / 16)), 2) + power(sum(x * h * sin(pi() * k * j / 16)), 2)) as s from (select *, 0.5 - 0.5 * cos(pi() * j / 16) as h from fq), (select unnest(range(0, 17)) as k) group by all)",
    "me": "me as (select file, frame, b, sum(s * s * greatest(0, least(k * 1.375 - b, b + 2 - k * 1.375)) * 22 / 500.0) as p from sp, (select unnest(range(0, 21)) as b) group by all)",
    "cf": "lg as (select file, frame, b, 10 * log10(greatest(p, 1e-10)) as g from me), cf as (select file, frame, c, sum(g * cos(pi() / 21 * (b + 0.5) * c)) * case when c = 0 then sqrt(1 / 21.0) else sqrt(2 / 21.0) end as v from (select file, frame, b, greatest(g, max(g) over (partition by file) - 80) as g from lg), (select unnest(range(0, 13)) as c) group by file, frame, c)",
    "zf": "y0 as (select file, i, n, coalesce(lead(x) over w - x, x - lag(x) over w, 0) / (1.01 * max(abs(x)) over (partition by file) + 1e-10) as z from s window w as (partition by file order by i)), z0 as (select file, i, n, z / (max(abs(z)) over (partition by file) + 1e-10) as z from y0)"
    + "".join(f", z{k + 1} as (select file, i, n, sum(z) over (partition by file order by i) as z from z{k})" for k in range(4))
    + "".join(f", z{k + 1} as (select file, i, n, z - avg(z) over (partition by file order by i rows between 8 preceding and 7 following) as z from z{k})" for k in range(4, 8))
    + ", z9 as (select file, i, n, case when i < 32 or i >= n - 32 then 0 else z end as z from z8), zf as (select file, i, n, z / (max(abs(z)) over (partition by file) + 1e-10) as z from z9)",
}

_SLOPE = "(select a.file, a.frame, a.c, case when a.h = 0 then any_value(a.v) else sum((b.frame - a.m) * b.v) / any_value(a.h * (a.h + 1) * (2 * a.h + 1) / 3.0) end as v from (select *, greatest(h, least(n - 1 - h, frame)) as m from (select *, least(4, (n - 1) // 2) as h from (select *, count(*) over (partition by file, c) as n from {0}))) a join {0} b on a.file = b.file and a.c = b.c and abs(b.frame - a.m) <= a.h group by a.file, a.frame, a.c, a.h)"


def _frames(spark, sf):
    return signal.frames_of(signals(spark, sf), FRAME, STEP)


def _long(rows: DataFrame, places: int = 6) -> DataFrame:
    """(file, frame, d, v): a row for each value."""
    return rows.select("file", "frame", F.posexplode("v").alias("d", "v")).select("file", "frame", F.col("d").cast("long").alias("d"), F.round("v", places).alias("v"))


@query("spectral_shape", "s fq sp", ", c as (select *, sum(s) over (partition by file, frame) as t, sum(s) over (partition by file, frame order by k) as c from sp) select file, frame, round(sum(s * k * 31.25) / any_value(t), 6) as centroid, 31.25 * count(*) filter (where c < 0.8 * t) as rolloff from c group by all")
def spectral_shape(spark, sf):
    rows = signal.by_frame(_frames(spark, sf), [("spectral_shape", "samples")], FS)
    return rounded(rows.select("file", "frame", F.element_at("v", 1).alias("centroid"), F.element_at("v", 2).alias("rolloff")), "centroid", "rolloff")


@query("spectral_flux", "s fq", ", k as (select file, frame, k, sqrt(power(sum(x * cos(pi() * k * j / 32)), 2) + power(sum(x * sin(pi() * k * j / 32)), 2)) as s from fq, (select unnest(range(0, 32)) as k) group by all), u as (select file, frame, k, s / (max(s) over (partition by file, frame) + 1e-10) as s from k) select file, frame, round(sum(coalesce(power(s - p, 2), 0)), 6) as flux from (select *, lag(s) over (partition by file, k order by frame) as p from u) group by all")
def spectral_flux(spark, sf):
    return rounded(signal.spectral_flux(_frames(spark, sf), FS), "flux")


@query("melspectrogram", "s fq sp me", "select file, frame, b::bigint as d, round(p, 3) as v from me")
def melspectrogram(spark, sf):
    return _long(signal.by_frame(_frames(spark, sf), [("melspectrogram", "samples")], FS), 3)


@query("mfcc", "s fq sp me cf", ", d1 as " + _SLOPE.format("cf") + ", d2 as " + _SLOPE.format("d1") + " select file, frame, (c + k * 13)::bigint as d, round(v, 6) as v from (select *, 0 as k from cf union all select *, 1 from d1 union all select *, 2 from d2)")
def mfcc(spark, sf):
    return _long(signal.with_slopes(signal.mfcc(_frames(spark, sf), FS)))


@query("autocorrelation_peak", "s fq", ", r as (select a.file, a.frame, b.j - a.j as lag, sum(a.x * b.x) as r from fq a join fq b on a.file = b.file and a.frame = b.frame and b.j >= a.j group by all), q as (select *, r / (max(r) filter (where lag = 0) over (partition by file, frame) + 1e-10) as v from r), l as (select *, lag(v) over w as p, lead(v) over w as f from q where lag >= 16 window w as (partition by file, frame order by lag)), m as (select file, frame, max(v) filter (where v > p and v > f) as v, arg_max(lag, v) filter (where v > p and v > f) as pk, any_value(v) filter (where lag = 16) as v0 from l group by all) select file, frame, round(coalesce(v, v0), 6) as height, round(coalesce(pk, 16) / 1000.0, 6) as period, round(1000.0 / coalesce(pk, 16), 6) as pitch from m")
def autocorrelation_peak(spark, sf):
    rows = signal.by_frame(_frames(spark, sf), [("autocorrelation_peak", "samples")], FS)
    return rounded(rows.select("file", "frame", *(F.element_at("v", k + 1).alias(c) for k, c in enumerate(("height", "period", "pitch")))), "height", "period", "pitch")


@query("zero_frequency_epochs", "s zf", ", c as (select *, lead(z) over w as a, lag(z) over w as b from zf window w as (partition by file order by i)), e as (select file, i, abs(a - b) as s from c where z <= 0 and a > 0 and b is not null), g as (select *, s / (max(s) over (partition by file) + 1e-10) as strength, 1000.0 / (lead(i) over (partition by file order by i) - i) as f from e) select file, i, round(strength, 6) as strength, round(coalesce(f, lag(f) over (partition by file order by i)), 6) as f0, strength > 0.7 * avg(strength) over (partition by file) as voiced from g")
def zero_frequency_epochs(spark, sf):
    series = signal.with_series(signal.waves_of(signals(spark, sf)), ["zero_frequency"], FS, FRAME, STEP)
    rows = series.select("file", F.posexplode("zero_frequency").alias("i", "z")).select("file", F.col("i").cast("long").alias("i"), "z")
    return rounded(signal.epochs(rows, FS), "strength", "f0")


_EPOCHS = ", c as (select *, lead(z) over w as a, lag(z) over w as b from zf window w as (partition by file order by i)), e as (select file, i, abs(a - b) as s from c where z <= 0 and a > 0 and b is not null), g as (select file, i, s / (max(s) over (partition by file) + 1e-10) as strength from e)"


@query("epochs", "s fq zf", _EPOCHS + " select fq.file, frame, count(strength) as n, round(coalesce(avg(strength), 0), 6) as strength from fq left join g on fq.file = g.file and g.i = fq.frame * 16 + fq.j group by all")
def epochs(spark, sf):
    seq = signals(spark, sf)
    series = signal.with_series(signal.waves_of(seq), ["zero_frequency"], FS, FRAME, STEP)
    found = signal.epochs(series.select("file", F.posexplode("zero_frequency").alias("i", "z")), FS).select("file", F.col("i").cast("long").alias("i"), "strength")
    rows = sequence.framed(seq.join(found, ["file", "i"], "left"), FRAME, STEP).groupBy("file", "frame")
    return rounded(rows.agg(F.count("strength").alias("n"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("strength")), "strength")


_REPORT = """, rf as (select file, i, n, case when x > 90 then -1 when x > 50 then 1 else 0 end as s, case when x > 90 then -1 when x < 40 then 1 else 0 end as m, (x > 45)::int as e from s),
es as (select *, case when i >= 2 and i < n - 2 then (2 * sum(e) over (partition by file order by i rows between 2 preceding and 1 following) > 4)::int else e end as p from rf),
lg as (select file, i, n, 'speech' as cls, greatest(s, 0) as y, case when s < 0 then 0 else p end as p from es union all select file, i, n, 'music', greatest(m, 0), case when m < 0 then 0 else 1 - p end from es),
df as (select file, cls, i, n, y - lag(y) over w as a, p - lag(p) over w as b from lg window w as (partition by file, cls order by i)),
r as (select t, file, cls, i, ceil(t / (10.0 * n + 15) * n) as w from df, (select unnest([10, 20, 60]) as t) where a > 0), e as (select distinct t, file, cls, i from df, (select unnest([10, 20, 60]) as t) where b > 0),
g as (select t, cls, count(*) as n, count(*) filter (where exists (select 1 from e where e.t = r.t and e.file = r.file and e.cls = r.cls and abs(e.i - r.i) <= r.w)) as tp from r group by all),
h as (select t, cls, n, tp, n - tp as fn, (select count(*) from e where e.t = g.t and e.cls = g.cls) - tp as fp from g), p as (select t as tolerance, cls, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(n) as n from h group by grouping sets ((t, cls), (t)))"""


@query("segmentation_report", "s", _REPORT + " select tolerance, cls, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, n::bigint as n, round(tp / (tp + fp + 1e-10), 6) as precision, round(tp / (tp + fn + 1e-10), 6) as recall, round(2 * (tp / (tp + fp + 1e-10)) * (tp / (tp + fn + 1e-10)) / (tp / (tp + fp + 1e-10) + tp / (tp + fn + 1e-10) + 1e-10), 6) as f1, round(fn / (n + 1e-10), 6) as deletion, round(fp / (n + 1e-10), 6) as insertion, round(fn / (n + 1e-10) + fp / (n + 1e-10), 6) as error from p")
def segmentation_report(spark, sf):
    seq = signals(spark, sf)
    x = F.col("x")
    meant = lambda own: F.when(x > 90, -1).when(own, 1).otherwise(0)
    ref = seq.select("file", "i", "n", meant(x > 50).alias("speech"), meant(x < 40).alias("music"))
    est = report.smoothed_labels(seq.select("file", "i", "n", (x > 45).cast("int").alias("m")), 5)
    return rounded(report.segmentation_report(ref, est, [10, 20, 60]), "precision", "recall", "f1", "deletion", "insertion", "error")


@query("noisy_signals", "s", ", k as (select file as noise, row_number() over (order by file) - 1 as k, count(*) over () as c from (select distinct file from s)), z as (select file, noise from (select distinct file from s) join k on k.k = (file + 1) % k.c), j as (select s.file, s.i, s.n, s.x, b.x as z from s join z using (file) join s b on b.file = z.noise and b.i = s.i % b.n), g as (select *, sqrt(avg(x * x) over w / pow(10, db / 10.0) / avg(z * z) over w) as g from j, (select unnest([10, 5, 0]) as db) window w as (partition by file, db)), y as (select file, i, db, x + g * z as y from g), c as (select file, i, db, y - avg(y) over (partition by file, db) as y from y) select file, db::double as snr_db, i, round(y / (max(abs(y)) over (partition by file, db) + 1e-7), 6) as x from c")
def noisy_signals(spark, sf):
    waves = signal.waves_of(signals(spark, sf))
    rows = report.noisy(waves, waves.withColumnRenamed("file", "noise"), [10, 5, 0], F.col("file") + 1)
    return rounded(rows.select("file", "snr_db", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x")


@query("fusion_by_noise_level", "sc", ", l as (select vec_id, label, db, feat, [p[1] * (1 + db / 10.0), p[2]] as p from sc, (select unnest([10, 5, 0]) as db)), f as (select vec_id, db, (any_value(label) >= 5)::int as y, case when avg(p[2]) > avg(p[1]) then 1 else 0 end as p from l group by vec_id, db), c as (select db, unnest([1, 0]) as cls, unnest([count(*) filter (where y = 1 and p = 1), count(*) filter (where y = 0 and p = 0)]) as tp, unnest([count(*) filter (where y = 0 and p = 1), count(*) filter (where y = 1 and p = 0)]) as fp, unnest([count(*) filter (where y = 1 and p = 0), count(*) filter (where y = 0 and p = 1)]) as fn from f group by db) select db as snr_db, cls, tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1 from c")
def fusion_by_noise_level(spark, sf):
    levels = scores(spark, sf).withColumn("snr_db", F.explode(F.array(*map(F.lit, (10, 5, 0)))))
    louder = levels.withColumn("p", F.array(F.element_at("p", 1) * (1 + F.col("snr_db") / 10), F.element_at("p", 2)))
    fused = fusion.score_mean(louder, ["vec_id", "snr_db"]).withColumnRenamed("label", "p_").drop("p")
    truth = vectors(spark, sf).select("vec_id", (F.col("label") >= 5).cast("int").alias("y"))
    return rounded(metrics.segment_stats(fused.join(truth, "vec_id").withColumnRenamed("p_", "p"), ["snr_db"]), "precision", "recall", "f1")


# What SQL can't say has no SQL here; tests/ check what of it they name.


@query("manova_stats")
def manova_stats(spark, sf):
    return spark.createDataFrame([stats.manova(vectors(spark, sf), "embedding", "label")], "wilks double, pillai double, hotelling double, roy double")


@query("cca_first")
def cca_first(spark, sf):
    return spark.createDataFrame([(stats.first_canonical(vectors(spark, sf), "embedding", 32),)], "r double")


@query("pca95")
def pca95(spark, sf):
    mean, axes = stats.principal(vectors(spark, sf), "embedding")
    return stats.projected(vectors(spark, sf), "embedding", mean, axes).select("vec_id", "z")


@query("hmm_viterbi")
def hmm_viterbi(spark, sf):
    seq = signals(spark, sf)
    model = models.hmm_fit(seq.withColumn("label", (F.col("x") > 50).cast("int")), states=2, rounds=5)
    return models.hmm_decode(seq, model)


@query("svm_rff_grid")
def svm_rff_grid(spark, sf):
    """All cells of the grid; labels are whether a vector's own is 5 or more."""
    rows = vectors(spark, sf).withColumn("label", (F.col("label") >= 5).cast("int"))
    found = svm.grid(rows, "vec_id", "label", "embedding")
    return spark.createDataFrame(found.cells, "cost double, gamma double, accuracy double")


@query("svm_predict")
def svm_predict(spark, sf):
    """The best of a few cells over all labels, fitted on all rows, and what it says of them."""
    found = svm.grid(vectors(spark, sf), "vec_id", "label", "embedding", [0.5, 4.0], [0.125, 0.5])
    return svm.predicted(vectors(spark, sf), found.model, "vec_id", "label", "embedding")


@query("dense_network")
def dense_network(spark, sf):
    """Of several depths and widths trained side by side the network of the least validation loss, and what it says of all rows."""
    scaled = split.standard_scaled(vectors(spark, sf), ["vec_id", "label"], [], "embedding")
    nets = network.fitted(scaled, "vec_id", "label", "z", [[32], [32, 32], [64, 64]], epochs=30)
    best = min(nets, key=lambda n: n.losses[n.best], default=None)
    return network.predicted(scaled, best, "vec_id", "label", "z").select("vec_id", "label", "p")


@query("smote_enn")
def smote_enn(spark, sf):
    """Two classes of very different sizes, balanced and cleaned."""
    rows = vectors(spark, sf).withColumn("label", (F.col("label") >= 8).cast("int"))
    found = balance.smote_enn(rows, "vec_id", "label", "embedding")
    return found.select("vec_id", "copy", "label", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("prepared_vectors")
def prepared_vectors(spark, sf):
    """Balanced, on principal axes, scaled: how many numbers each row has left."""
    found = balance.prepared(vectors(spark, sf), "vec_id", "label", "embedding")
    return found.select("vec_id", "copy", "label", F.size("z").alias("axes"))


@query("canonical_pairs")
def canonical_pairs(spark, sf):
    found = stats.canonical_pairs(vectors(spark, sf), "vec_id", "embedding", {"a": (0, 10), "b": (10, 30), "c": (30, 64)})
    return rounded(found, "r", "pearson", "spearman")


@query("hmm_chunks")
def hmm_chunks(spark, sf):
    """The sequence model over chunks of 64 samples: the same paths as over whole files."""
    seq = signals(spark, sf)
    model = models.hmm_fit(seq.withColumn("label", (F.col("x") > 50).cast("int")), states=2, rounds=5, chunk=64)
    return chunks.decoded(seq, model, 64)


@query("mlp")
def mlp(spark, sf):
    return models.mlp_predict(vectors(spark, sf), "label", "embedding", "vec_id", [32])


@query("chroma")
def chroma(spark, sf):
    return _long(signal.by_frame(_frames(spark, sf), [("chroma", "samples"), ("chroma_change", "samples")], FS))


@query("hngdmfcc")
def hngdmfcc(spark, sf):
    return _long(signal.with_slopes(signal.by_frame(_frames(spark, sf), [("hngdmfcc", "samples")], FS)))


@query("mgdcc")
def mgdcc(spark, sf):
    return _long(signal.with_slopes(signal.by_block(_frames(spark, sf), "mgdcc", FS, STEP)))


@query("ifcc")
def ifcc(spark, sf):
    return _long(signal.with_slopes(signal.by_block(_frames(spark, sf), "ifcc", FS, STEP)))


@query("mgdcc_sweep")
def mgdcc_sweep(spark, sf):
    steps = [k / 10 for k in range(1, 11)]
    return signal.swept(_frames(spark, sf), steps, steps).groupBy("rho", "gamma").agg(F.count("*").alias("frames"), F.round(F.avg(F.element_at("v", 1)), 6).alias("first"))


@query("wave_series")
def wave_series(spark, sf):
    kinds = list(signal.WAVES)
    rows = signal.with_series(signal.waves_of(signals(spark, sf)), kinds, FS, FRAME, STEP)
    return rounded(rows.select("file", F.posexplode(F.arrays_zip(*kinds)).alias("i", "k")).select("file", F.col("i").cast("long").alias("i"), "k.*"), *kinds)


@query("source_features")
def source_features(spark, sf):
    return _long(signal.source_features(signal.waves_of(signals(spark, sf)), FS, FRAME, STEP))


@query("texture_features")
def texture_features(spark, sf):
    seq = signals(spark, sf)
    return _long(signal.texture_features(signal.waves_of(seq), silence.audible_frames(seq, FRAME, STEP, 0.9), FS, FRAME, STEP))


@query("group_delays")
def group_delays(spark, sf):
    """The whole family, long: a row for each frame, kind and bin."""
    rows = signal.group_delays(_frames(spark, sf), FS)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in signal.DELAYS))).alias("k")
    return rows.select("file", "frame", kinds).select("file", "frame", "k.kind", F.posexplode("k.v").alias("bin", "v")).withColumn("v", F.round("v", 6))


#: Vectors stand in for frames of a file of their label.
FRAMES_SQL = "f as (select label as file, row_number() over (partition by label order by vec_id) - 1 as i, embedding[1:4]::double[] as v, count(*) over (partition by label) as n from embeddings)"


def _vector_frames(spark, sf):
    rows = vectors(spark, sf).where("label is not null").select(F.col("label").alias("file"), "vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("v"))
    return ranks.running(rows, ["file"], ["vec_id"], "i", "n").select("file", "i", "v")


SCALED_SQL = ", e as (select file, i, unnest(range(4)) as d, unnest(v) as x from f), z as (select file, i, d, coalesce((x - avg(x) over w) / nullif(stddev_pop(x) over w, 0), 0) as x from e window w as (partition by file, d))"


@query("centred_patches", "", f"with {FRAMES_SQL}{SCALED_SQL}, p as (select file, unnest(range((n + 4) // 5)) as patch from (select distinct file, n from f)), q as (select file, patch, unnest(range(8)) as place from p)"
       " select q.file, q.patch::bigint as patch, round(sum(coalesce(x, 0) * (place + 1) * (d + 1)), 6) as digest from q left join z on z.file = q.file and z.i = q.patch * 5 - 4 + q.place group by q.file, q.patch")
def centred_patches(spark, sf):
    """Patches of 8 frames around every fifth, as a weighted sum of their numbers."""
    m = tensors.centred_patches(_vector_frames(spark, sf), 8, 5)
    long = m.select("file", "patch", F.posexplode("m").alias("place", "v")).select("file", "patch", "place", F.posexplode("v").alias("d", "x"))
    return rounded(long.groupBy("file", "patch").agg(F.sum(F.col("x") * (F.col("place") + 1) * (F.col("d") + 1)).alias("digest")), "digest")


@query("random_patches")
def random_patches(spark, sf):
    m = tensors.random_patches(_vector_frames(spark, sf), 8, 5, seed=3, pick=[0, 2])
    return m.select("file", "patch", F.transform(F.flatten("m"), lambda x: F.round(x, 6)).alias("m"))


@query("wave_patches")
def wave_patches(spark, sf):
    m = tensors.wave_patches(signals(spark, sf).select("file", "i", "x"), 32, 24, seed=3)
    return m.select("file", "patch", F.transform("m", lambda x: F.round(x, 6)).alias("m"))


@query("name_match", "", "with f as (select distinct 'src' || (doc_id % 20) || '_' || lang as file from documents), p as (select distinct 'run/' || source || '_' || lang || '_fold' || (doc_id % 3) || '.pkl' as name from documents) "
       "select file, arg_min(name, (length(name), name)) as prediction from f join p on contains(name, file || '_fold1') group by file")
def name_match(spark, sf):
    """Files meet the predictions whose names contain theirs and a fold's."""
    docs = table(spark, sf, "documents")
    files = docs.select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("_"), "lang").alias("file"))
    names = docs.select(F.concat(F.lit("run/"), "source", F.lit("_"), "lang", F.lit("_fold"), (F.col("doc_id") % 3).cast("string"), F.lit(".pkl")).alias("name"))
    return tensors.named_match(files, names, "_fold1")


@query("file_scores")
def file_scores(spark, sf):
    """Networks of two feature families, fitted, kept, read back, scored on patches around each frame, fused and cut to the labels."""
    frames = _vector_frames(spark, sf)
    found = None
    for feat, pick in (("low", [0, 1]), ("high", [2, 3])):
        own = frames.select("file", "i", F.array(*(F.get("v", k) for k in pick)).alias("v"))
        patches = tensors.centred_patches(own, 4, 2).withColumn("x", F.flatten("m"))
        rows = written(patches.select(F.struct("file", "patch").alias("key"), (F.col("file") % 2).alias("y"), "x"), "patches")  # read by each pass and by the scoring
        net = network.fitted(rows, "key", "y", "x", [[8]], epochs=5)[0]
        folder = shared_folder(spark, f"model-{feat}")
        store.save_model(spark, folder, {"classes": net.classes, "sizes": net.sizes, "weights": net.weights})
        net = network.Network(**store.load_model(spark, folder))
        own = network.predicted(rows, net, "key", "y", "x").select("key.file", F.lit(feat).alias("feat"), "key.patch", F.col("shares").alias("p"))
        found = own if found is None else found.union(own)
    labels = frames.where("i % 2 = 0").select("file", (F.col("i") / 2).cast("long").alias("patch"), (F.col("file") % 2).alias("y"))
    out = tensors.fused_scores(found, ["low", "high"], labels)
    return out.select("file", "patch", F.transform("p", lambda x: F.round(x, 6)).alias("p"), "y")


@query("noise_recognition")
def noise_recognition(spark, sf):
    """Users' signals, told apart by whether they have more events than most, under other users' signals as noise."""
    waves = signal.waves_of(signals(spark, sf)).withColumn("cls", (F.size("samples") > 66).cast("int"))
    setting = recognition.Setting(SIZE, HOP, 3, 2, FS)
    found = recognition.noise_report(waves, waves.select(F.col("file").alias("noise"), "samples"), [10.0, 0.0], ["spectral_shape", "log_mel_sum"], setting, [8], epochs=10)
    return rounded(found, "precision", "recall", "f1")


@query("phase_features")
def phase_features(spark, sf):
    rows = signal.phase_features(_frames(spark, sf), FS, STEP)
    return _long(rows.select("file", "frame", F.concat("hngd", "mgd", "ifc").alias("v")))


def _series_frames(spark, sf, family):
    series = signal.with_series(signal.waves_of(signals(spark, sf)), [family], FS, FRAME, STEP)
    return signal.frames_of_waves(series, FRAME, STEP, ("samples", family))


@query("modulation_4hz")
def modulation_4hz(spark, sf):
    return _long(signal.by_frame(_series_frames(spark, sf, "modulation_4hz"), [("mean", "modulation_4hz")], FS))


@query("residual_energy")
def residual_energy(spark, sf):
    """A frame's energy left by the predictor, over the frame's own."""
    rows = signal.by_frame(_series_frames(spark, sf, "residual"), [("energy", "residual"), ("energy", "samples")], FS)
    return rounded(rows.select("file", "frame", F.coalesce(F.try_divide(F.element_at("v", 1), F.element_at("v", 2)), F.lit(0.0)).alias("share")), "share")


@query("gmm_hmm")
def gmm_hmm(spark, sf):
    """Two normal densities a state, fitted on labels that a classifier gave, then the best paths' scores."""
    seq = signals(spark, sf).withColumn("label", (F.col("x") > 50).cast("int"))
    found = models.hmm_decode(seq, models.hmm_fit(seq, mixtures=2)).join(seq, ["file", "i"])
    return rounded(metrics.segment_stats(found.select(F.col("label").alias("y"), F.col("state").alias("p"))), "precision", "recall", "f1")
