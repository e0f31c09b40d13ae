"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule is a statistic of the text in whole per mille, 0 to 1000, the higher the worse. For each
stratum cutoffs of all rules are chosen on labelled documents so that, with confidence 1 - delta over all
strata together, at most a share alpha of the stratum's good documents is rejected, whichever rule does it.

The labelled documents are halved by doc_id. On one half each rule gets the cutoff that rejects most bad
documents, less COST for each good one. These cutoffs are then moved together: a document's score
is its largest value in relation to the cutoff, and what's above a level of the score is rejected. The other
half, the holdout, certifies levels: one may reject k of the stratum's n good holdout documents only if P(Binomial(n, alpha) <= k)
<= delta / strata (Bonferroni over strata; the sets along the score are nested, so that levels are
tested in a fixed order without a further correction). Among the certified levels the one is taken that
gains most in the holdout; a stratum with too few labels, or where nothing is gained, rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

SPACES = r"[\x20\x09-\x0D]+"
RULES = ["symbol_share", "duplicate_line_share", "capital_share", "repeat_share"]
#: Share of a stratum's good documents that all rules together may reject, and the odds of failing that anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Bad documents that a rule must reject to make up for a good one.
COST = 5
#: 0 for the half of the labelled documents that sets the rules' cutoffs; the others are the holdout.
HALF = "(doc_id % 1000003 * 7919 div 1024) % 2"
#: Cutoffs of up to so many strata are broadcast.
STRATA = 10_000


def _repeated(ordered: Column) -> Column:
    """How many words lie in windows of equal hashes; ordered: the windows' (h, i), sorted."""
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    return F.aggregate(found, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda t, i: F.struct(i.alias("last"), (t["n"] + F.least(F.lit(3), i - t["last"])).alias("n")), lambda t: t["n"])


def _share(part: str, whole: str) -> Column:
    return F.expr(f"if({whole} > 0, least(1000L, cast({part} as bigint) * 1000 div {whole}), 0L)")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __q: a struct of the base statistics and the rules' values of each whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, and RULES. A null
    or empty text, or one of white space, has none of these and fails the base. Windows of three words
    are told by 64-bit hashes. The steps are columns of their own, so that each is worked out once; a
    filter on __q would be pushed below them, and so __q is to be saved before it's filtered on.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumn("__t", t).withColumn("__w", F.filter(F.split("__t", SPACES), lambda w: w != ""))
    parts = parts.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__w")
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    parts = parts.withColumn("__h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    parts = parts.withColumn("__o", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    counted = parts.withColumn(
        "__c",
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(_repeated(F.col("__o")), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("__l").cast("long").alias("n_lines"),
            F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        ),
    )
    failed = F.expr("__c.n_words < 50 or 100 * __c.n_repeat_words > 50 * __c.n_words")
    shares = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_capitals", "word_chars"), ("n_repeat_words", "n_words")]
    base = [F.col(f"__c.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    values = [_share(f"__c.{a}", f"__c.{b}").alias(rule) for rule, (a, b) in zip(RULES, shares)]
    return counted.withColumn("__q", F.struct(*base, failed.alias("base_failed"), *values)).drop("__t", "__w", "__l", "__h", "__o", "__c")


def _allowed(alpha: float, n: str, level: str) -> Column:
    """The largest k with P(Binomial(n, alpha) <= k) <= level, or -1; the terms are summed in order."""
    return F.expr(f"""aggregate(
        sequence(0, cast(ceil({alpha} * {n}) as int)),
        named_struct('l', 0D, 'p', 0D, 'k', -1),
        (t, i) -> named_struct(
            'l', if(i = 0, {n} * ln(1 - {alpha}D), t.l + ln(({n} - i + 1) / i) + ln({alpha}D / (1 - {alpha}D))),
            'p', t.p + exp(if(i = 0, {n} * ln(1 - {alpha}D), t.l + ln(({n} - i + 1) / i) + ln({alpha}D / (1 - {alpha}D)))),
            'k', if(t.p + exp(if(i = 0, {n} * ln(1 - {alpha}D), t.l + ln(({n} - i + 1) / i) + ln({alpha}D / (1 - {alpha}D)))) <= {level}, i, t.k))).k""")


def _best(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows' histogram by the columns ``by`` and the value: how many good and bad ones lie above each value, n good ones in all."""
    held = rows.groupBy(*by, value).agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad"))
    above = Window.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("good", "bad")]
    return held.select("*", *sums, F.sum("good").over(Window.partitionBy(*by)).alias("n")).withColumn("gain", F.col("bad_above") - COST * F.col("good_above"))


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, good_above, allowed): the cutoffs of strata with a certified level that gains something.

    stats: doc_id, stratum and RULES; labels: doc_id, quality (1 good, 0 bad; other values and nulls are
    not used). Labels that repeat a doc_id count once, as good if any says so; rows of stats that repeat one
    count each. good_above and allowed are of the stratum's holdout: how many good ones all rules together reject, and
    may reject. Histograms by stratum and value are all that's shuffled.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = common.saved(stats.select("doc_id", "stratum", *RULES).join(known, "doc_id"), "labelled")
    first, holdout = joined.where(f"{HALF} = 0"), joined.where(f"{HALF} != 0")
    long = first.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES))).alias("x"))
    tried = _best(long.select("stratum", "quality", "x.*"), ["stratum", "rule"], "value").where("gain > 0")
    best = tried.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "value")).alias("b"))
    scale = common.saved(best.select("stratum", "rule", (F.col("b.value") + 1).alias("scale")), "scales")
    wide = scale.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("scale"))).alias(f"__{r}") for r in RULES))
    scores = [F.expr(f"coalesce({r} * 1000 div __{r}, 0L)") for r in RULES]
    scored = holdout.join(wide, "stratum", "left").select("stratum", "quality", F.greatest(*scores).alias("score"))
    held = _best(scored, ["stratum"], "score")
    sizes = held.select("stratum", "n").distinct()
    tests = sizes.agg(F.count("*").alias("tests"))  # one row
    allowed = sizes.join(F.broadcast(tests)).select("stratum", _allowed(alpha, "n", f"{delta}D / tests").alias("allowed"))
    certified = held.join(allowed, "stratum").where("good_above <= allowed and gain > 0")
    level = certified.groupBy("stratum").agg(F.max(F.struct("gain", "score", "good_above", "allowed")).alias("b"))
    # A value whose score is above the level is more than this cutoff.
    cutoff = F.expr("((b.score + 1) * scale + 999) div 1000 - 1")
    return level.join(scale, "stratum").select("stratum", "rule", cutoff.alias("cutoff"), "b.good_above", "b.allowed")


def _rejected(rows: DataFrame, chosen: DataFrame, value: str) -> DataFrame:
    """rows (with __stratum) and __rejected: whether a rule's value lies above its stratum's cutoff."""
    by = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES)).withColumnRenamed("stratum", "__stratum")
    by = common.saved(by, "cutoffs")
    if by.count() <= STRATA:
        joined = rows.join(F.broadcast(by), "__stratum", "left")
    else:
        sizes = rows.groupBy("__stratum").agg(F.count("*").alias("__n"))
        joined = common.hot_left_join(rows, by.join(sizes, "__stratum"), ["__stratum"], F.monotonically_increasing_id(), "__n")
    high = F.lit(False)
    for r in RULES:
        high = high | F.coalesce(F.col(value.format(r)) > F.col(f"__{r}"), F.lit(False))
    return joined.withColumn("__rejected", high).drop(*(f"__{r}" for r in RULES), "__stratum")


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _judged(docs: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """doc_id, __x (a hash of the text), the base statistics, base_failed and kept of each row."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__x"), _stratum(docs).alias("__stratum"))
    stats = common.saved(statistics(rows).select("doc_id", "__x", "__stratum", "__q.*"), "quality")
    found = _rejected(stats, cutoffs(stats.withColumnRenamed("__stratum", "stratum"), labels, alpha, delta), "{}")
    kept = ~F.col("base_failed") & ~F.col("__rejected")
    return found.select("doc_id", "__x", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept: a row for each row of docs (doc_id, text, lang).

    The stratum is lang; without that column, or where it's null, it's the empty one. A null text has
    no words and fails. Other columns of docs aren't looked at. An empty table gives no rows, and
    without labels nothing but the base rejects.
    """
    return _judged(docs, labels, alpha, delta).drop("__x")


def kept(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judged keeps, with all their columns. Rows are told by doc_id (null is an id) and text."""
    d, x = common.unused(docs.columns, "gone_id", "gone_text")
    gone = _judged(docs, labels, alpha, delta).where("not kept").select(F.col("doc_id").alias(d), F.col("__x").alias(x)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(x)), "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document, with cutoffs certified on labels by language."""
    return judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


#: The same by unnesting words, and with the binomial terms from log-gamma.
STATISTICS_SQL = r"""
d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select doc_id, stratum, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
p as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] as g from p),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
h as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id),
c as (select w.doc_id, stratum, len(ws)::bigint as n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
      coalesce(h.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, len(regexp_extract_all(t, '[A-Z]'))::bigint as n_capitals
      from w left join h using (doc_id)),
q as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
      if(word_chars > 0, least(1000, n_symbols * 1000 // word_chars), 0) as symbol_share,
      if(n_lines > 0, least(1000, n_dup_lines * 1000 // n_lines), 0) as duplicate_line_share,
      if(word_chars > 0, least(1000, n_capitals * 1000 // word_chars), 0) as capital_share,
      if(n_words > 0, least(1000, n_repeat_words * 1000 // n_words), 0) as repeat_share from c)
"""
CUTOFFS_SQL = f"""
k as (select doc_id, max(quality) as quality from labels where quality in (0, 1) group by doc_id),
l as (select stratum, quality, rule, value from (unpivot (select doc_id, stratum, symbol_share, duplicate_line_share, capital_share, repeat_share from q where {HALF.replace('div', '//')} = 0)
      on symbol_share, duplicate_line_share, capital_share, repeat_share into name rule value value) join k using (doc_id)),
v as (select stratum, rule, value, sum(quality) as good, sum(1 - quality) as bad from l group by all),
a as (select stratum, rule, value, coalesce(sum(bad) over up, 0) - {COST} * coalesce(sum(good) over up, 0) as gain
      from v window up as (partition by stratum, rule order by value desc rows between unbounded preceding and 1 preceding)),
e as (select stratum, rule, max(struct_pack(gain := gain, value := value)).value + 1 as scale from a where gain > 0 group by stratum, rule),
f as (select q.doc_id, q.stratum, quality, coalesce(max(case e.rule when 'symbol_share' then symbol_share when 'duplicate_line_share' then duplicate_line_share
      when 'capital_share' then capital_share else repeat_share end * 1000 // scale), 0) as score
      from q join k using (doc_id) left join e on e.stratum = q.stratum where {HALF.replace('div', '//').replace('doc_id', 'q.doc_id')} <> 0 group by all),
u as (select stratum, score, sum(quality) as good, sum(1 - quality) as bad from f group by all),
o as (select stratum, score, coalesce(sum(good) over up, 0) as good_above, coalesce(sum(bad) over up, 0) as bad_above, sum(good) over (partition by stratum) as n
      from u window up as (partition by stratum order by score desc rows between unbounded preceding and 1 preceding)),
s as (select distinct stratum, n from o),
b as (select stratum, n, i, sum(case when n > 0 then exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})) else 1 end)
      over (partition by stratum order by i) as p from (select stratum, n, unnest(range(0, ceil({ALPHA} * n)::bigint + 1)) as i from s)),
m as (select stratum, coalesce(max(i) filter (where p <= {DELTA} / (select count(*) from s)), -1) as allowed from b group by stratum),
x as (select stratum, score, bad_above - {COST} * good_above as gain from o join m using (stratum) where good_above <= allowed),
z as (select stratum, max(struct_pack(gain := gain, score := score)).score as score from x where gain > 0 group by stratum),
y as (select stratum, rule, ((score + 1) * scale + 999) // 1000 - 1 as cutoff from z join e using (stratum))
"""
ORACLES = {
    "op5_quality_rules": f"""with {STATISTICS_SQL}, {CUTOFFS_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not exists (
    select 1 from y where y.stratum = q.stratum and (rule = 'symbol_share' and symbol_share > cutoff or rule = 'duplicate_line_share' and duplicate_line_share > cutoff
    or rule = 'capital_share' and capital_share > cutoff or rule = 'repeat_share' and repeat_share > cutoff)) as kept from q"""
}
QUERIES = {"op5_quality_rules": op5_quality_rules}
