"""URL filters: host and path rules, and for URLs that no rule fits boosted trees on lexical features.

DataFrame functions and pyspark.ml alone. The trees are trained on labelled URLs; by default these are
the URLs that rules fit, whose verdicts are the labels. At most TRAIN_ROWS labelled URLs are taken, by
the order of their hashes; suffix statistics are counted over all URLs. A URL that trains never sees its own label
in its suffix's share of blocked ones: labelled URLs are halved by a hash, and each half gets the other's shares.
Statistics are counted by suffix, and by suffix and the path's first part. A suffix without labels gets the share of all labels and the mean count of labelled URLs' suffixes, so that
the other features decide there.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, rule): a rule's host, then its path's beginning.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labelled URLs that the trees are trained on, at the most.
TRAIN_ROWS = 10_000
LEXICAL = ["f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels"]
#: What statistics are counted by: the host's last label, and this with the path's first part, as in com/fr.
KEYS = ["suffix", "section"]
FEATURES = [*LEXICAL, *(f"f_{key}_{name}" for key in KEYS for name in ("count", "blocked"))]


def located(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host (A-Z lower-cased) and path; both are empty for nulls and where there's no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _first_rule(rules: list[tuple[str, str]], verdict: bool) -> Column:
    """The longest rule that fits host and path, or its verdict; null if none does."""
    out = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(kind if verdict else rule)).otherwise(out)
    return out


def ruled(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """urls with host, path, rule and by_rule (its verdict), the last two null where no rule fits."""
    return located(urls, url).withColumn("rule", _first_rule(rules, False)).withColumn("by_rule", _first_rule(rules, True))


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows (with host and path) and their lexical features but those of KEYS; suffix: the host's last label, section: this and the path's first part."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u).cast("double")
    chars = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda t, c: t - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "section": F.concat_ws("/", F.substring_index("host", ".", -1), F.coalesce(F.get(F.filter(F.split("path", "/"), lambda s: s != ""), 0), F.lit(""))),
            "f_length": n,
            "f_host_length": F.length("host").cast("double"),
            "f_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "f_digits": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
            "f_entropy": F.round(entropy, 9),
            "f_params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
            "f_hyphens": F.regexp_count(F.col("host"), F.lit("-")).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        }
    )


def _half(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(F.col(url), F.lit(1)), F.lit(2)).cast("int")


def suffixes(rows: DataFrame, labelled: DataFrame, key: str = "suffix") -> DataFrame:
    """A row for each suffix (or other key) of rows or labelled: the key, n (rows with it), m and blocked (its labels), m0, m1, blocked0, blocked1 (by half)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    half = [F.coalesce(F.sum(F.when(F.col("half") == k, x)), F.lit(0)).alias(f"{name}{k}") for k in (0, 1) for name, x in (("m", F.lit(1)), ("blocked", F.col("label")))]
    marks = labelled.withColumn("half", _half()).groupBy(key).agg(F.count("*").alias("m"), F.sum("label").alias("blocked"), *half)
    both = counts.join(marks, key, "full")
    return both.na.fill(0, ["n", "m", "blocked", "m0", "m1", "blocked0", "blocked1"])


class Shares:
    """Features of a key from the table of ``suffixes``, in which the driver sums up two numbers."""

    def __init__(self, table: DataFrame, key: str = "suffix"):
        self.table, self.key = table, key
        self.names = f"f_{key}_count", f"f_{key}_blocked"
        row = table.agg(F.sum("m").alias("m"), F.sum("blocked").alias("blocked"), F.sum(F.log1p("n") * F.col("m")).alias("count")).first()
        #: Share of blocked labels, and the mean of the count over labelled URLs.
        self.prior = (row.blocked / row.m) if row.m else 0.5
        self.count = (row["count"] / row.m) if row.m else 0.0

    def _columns(self, m: Column, blocked: Column) -> list[Column]:
        count = F.when(F.col("m") > 0, F.log1p("n")).otherwise(self.count)
        return [F.coalesce(count, F.lit(self.count)).alias(self.names[0]), F.coalesce((blocked + 2 * self.prior) / (m + 2), F.lit(self.prior)).alias(self.names[1])]

    def of_labelled(self, labelled: DataFrame) -> DataFrame:
        """labelled (url, the key, label, ...) with the key's features, the shares from the other half."""
        other = lambda name: F.when(F.col("__half") == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
        joined = labelled.withColumn("__half", _half()).join(self.table, self.key, "left")
        return joined.select(*labelled.columns, *self._columns(other("m"), other("blocked")))

    def of_all(self, rows: DataFrame) -> DataFrame:
        """rows (page_id, url, the key, ...) with the key's features from all labels; a suffix may hold most rows."""
        features = self.table.select(self.key, *self._columns(F.col("m"), F.col("blocked")), "n")
        return common.hot_left_join(rows, features, [self.key], F.struct("page_id", "url"), "n").na.fill(dict(zip(self.names, (self.count, self.prior))))


def trained(rows: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7):
    """A boosted model of rows (FEATURES, label 0 or 1), or the only label there is, 0 for no rows."""
    labels = [r.label for r in rows.select("label").distinct().collect()]  # two at the most
    if len(labels) < 2:
        return float(labels[0]) if labels else 0.0
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", F.col("label").cast("double"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(data)


def scored(rows: DataFrame, model) -> DataFrame:
    """rows with prediction (1.0: block)."""
    if isinstance(model, float):
        return rows.withColumn("prediction", F.lit(model))
    found = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(rows)
    return model.transform(found.withColumnRenamed("__features", "features")).drop("features", "rawPrediction", "probability")


def _known(rows: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """url, KEYS, lexical features and label of the labelled URLs."""
    if labelled is None:
        return rows.where("by_rule is not null").select("url", *KEYS, *LEXICAL, (F.col("by_rule") == "block").cast("int").alias("label"))
    marked = labelled.select("url", F.col("label").cast("int")).where("label in (0, 1)")
    return lexical(located(marked)).select("url", *KEYS, *LEXICAL, "label")


def fitted(rows: DataFrame, known: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[object, list[Shares]]:
    """The model and the shares by KEYS, from rows and labelled URLs with their lexical features."""
    shares = [Shares(common.saved(suffixes(rows, known, key), key), key) for key in KEYS]
    sample = known.orderBy(F.xxhash64("url"), "url", "label").limit(train_rows)
    for own in shares:
        sample = own.of_labelled(sample)
    return trained(common.saved(sample, "urls")), shares


def _with_shares(rows: DataFrame, shares: list[Shares]) -> DataFrame:
    for own in shares:
        rows = own.of_all(rows)
    return rows


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, a row for each row of pages (page_id, url).

    labelled: (url, label 1 for block), in place of the URLs that rules fit; other labels and nulls aren't used.
    With labels of one kind the method gives that verdict, without labels it allows. Null and empty urls have an
    empty host and path and go to the method. page_id may be null or repeated, equal urls get equal verdicts;
    an empty table gives no rows; other columns aren't looked at.
    """
    rows = lexical(ruled(pages.select("page_id", "url"), rules))
    model, shares = fitted(rows, _known(rows, labelled), train_rows)
    verdict = F.coalesce("by_rule", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    return scored(_with_shares(rows, shares), model).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def held_out(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """(label, prediction, n) of the labelled URLs of one fold by hash, under a model fitted on the others."""
    rows = lexical(ruled(pages.select("page_id", "url"), rules))
    known = common.saved(_known(rows, labelled).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(2)), F.lit(folds))), "labelled")
    model, shares = fitted(rows, known.where("fold != 0"))
    tested = _with_shares(known.where("fold = 0").withColumn("page_id", F.lit(None).cast("long")), shares)
    return scored(tested, model).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and trees on every url of pages."""
    return judged(common.table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES: dict[str, str] = {}
