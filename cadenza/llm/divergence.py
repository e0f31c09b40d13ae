"""How far the sources of a language differ in the terms they use, from joint histograms of counts.

Two sources are compared over all kept terms of their language by a function f of the two counts of a term. As f sees
counts alone, it's enough to know how many terms have the counts (x, y) in the two sources: their joint histogram. Tasks
tally the distinct (x, y) of the terms that both sources have; the cells of terms that one of them, or neither, has are
implied by each source's own histogram and the number of terms. f is taken once for each cell, times its number of terms.

The result holds a row for each two sources of a language, so there are few sources beside documents and
terms; a term's list has an entry for each source at most. Pairs of sources are formed in a task, in numpy, and leave it as tallies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

#: Pairs of cells that a task forms at once.
PAIRS = 1_000_000
_KINDS = np.full(256, words.GAP, np.uint8)
_KINDS[97:123] = _KINDS[128:] = words.WORD  # letters, lower-cased before, and all beyond ASCII
CELLS = "lang string, a string, b string, x long, y long, n long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of a term in a group and the group's documents that have it.

    The empty term with a count of 0 stands for each group itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            many = max(1, len(sources.dictionary))
            groups, group = words.numbered(langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy())

            def out(own: np.ndarray, term: pa.Array, count: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
                lang, source = langs.dictionary.take(pa.array(groups[own] // many)), sources.dictionary.take(pa.array(groups[own] % many))
                return pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "count", "docs"])

            none = np.zeros(len(groups), np.int64)
            yield out(np.arange(len(groups)), pa.array([""] * len(groups), pa.string()), none, none)
            for at, w in words.slices(batch.column(0), _KINDS):
                size = max(1, len(w.distinct))
                inside, times = np.unique(w.text * size + w.code, return_counts=True)  # (text, term)
                keys, number = words.numbered(group[at + inside // size] * size + inside % size)
                count = np.zeros(len(keys), np.int64)
                np.add.at(count, number, times)
                yield out(keys // size, w.names().take(pa.array(keys % size)), count, np.bincount(number, minlength=len(keys)))

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = texts.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _tallies(lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (lang, a, b, x, y, n), a < b, of terms (lang, cells sorted by source); what they take from implied cells is negative."""
    for batch in lists:
        cells = batch.column(1)
        sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = cells.flatten()
        source, count = flat.field(0).dictionary_encode(), flat.field(1).to_numpy()
        names, own = source.dictionary, source.indices.to_numpy().astype(np.int64)
        lang = batch.column(0).dictionary_encode()
        langs = lang.indices.to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for size in np.unique(sizes[sizes > 1]).tolist():
            terms = np.flatnonzero(sizes == size)
            for low in range(0, size - 1, step := max(1, PAIRS // size)):  # the first source's places in the list
                u, v = (k.ravel() for k in np.meshgrid(np.arange(low, min(low + step, size - 1)), np.arange(size), indexing="ij"))
                u, v = u[u < v], v[u < v]
                for at in range(0, len(terms), many := max(1, PAIRS // len(u))):
                    some = terms[at : at + many]
                    i, j = (starts[some, None] + u).ravel(), (starts[some, None] + v).ravel()
                    yield from _tally(lang.dictionary, np.repeat(langs[some], len(u)), names, own[i], own[j], count[i], count[j])


def _tally(langs: pa.Array, lang: np.ndarray, names: pa.Array, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs, pair = words.numbered((lang * len(names) + a) * len(names) + b)
    xs, x = words.numbered(x)
    ys, y = words.numbered(y)
    both, cell = words.numbered((pair * len(xs) + x) * len(ys) + y)
    n = np.bincount(cell, minlength=len(both))

    def out(own: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        key = pairs[own]
        columns = [langs.take(pa.array(key // len(names) ** 2)), names.take(pa.array(key // len(names) % len(names))), names.take(pa.array(key % len(names)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(k, pa.int64()) for k in (x, y, n))], names=["lang", "a", "b", "x", "y", "n"])

    own, px, py = both // len(ys) // len(xs), both // len(ys) % len(xs), both % len(ys)
    yield out(own, xs[px], ys[py], n)
    for side, values in ((px, xs), (py, ys)):  # these terms aren't of the one source alone
        keys, number = words.numbered(own * len(values) + side)
        less, zero = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.subtract.at(less, number, n)
        mine = values[keys % len(values)]
        yield out(keys // len(values), *((mine, zero) if side is px else (zero, mine)), less)
    many = np.zeros(len(pairs), np.int64)
    np.add.at(many, own, n)
    yield out(np.arange(len(pairs)), many * 0, many * 0, many)


def joint_histograms(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, n): n terms have the counts x in source a and y in source b; zero counts are included.

    terms (lang, term, cells array<struct<source, count>> sorted by source, counts over 0), a row for each kept term;
    pairs (lang, a, b), a < b, lists what is compared.
    """
    shared = terms.select("lang", "cells").mapInArrow(_tallies, CELLS)
    own = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("s"), F.col("c.count").alias("k")).agg(F.count("*").alias("m"))
    size = terms.groupBy("lang").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    first, second = pairs.join(own.withColumnRenamed("s", "a"), ["lang", "a"]), pairs.join(own.withColumnRenamed("s", "b"), ["lang", "b"])
    implied = [
        first.select("lang", "a", "b", F.col("k").alias("x"), zero.alias("y"), F.col("m").alias("n")),
        second.select("lang", "a", "b", zero.alias("x"), F.col("k").alias("y"), F.col("m").alias("n")),
        first.union(second.select(first.columns)).select("lang", "a", "b", zero.alias("x"), zero.alias("y"), (-F.col("m")).alias("n")),
        pairs.join(size, "lang").select("lang", "a", "b", zero.alias("x"), zero.alias("y"), "n"),
    ]
    for part in implied:
        shared = shared.union(part)
    return shared.groupBy("lang", "a", "b", "x", "y").agg(F.sum("n").alias("n")).where("n != 0")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly; null without terms."""
    exact = "cast({} as decimal(20,0))".format
    return F.expr(f"case when {terms} > 0 then 1 + (1000000000 * ({exact(count)} + 5)) div ({exact(total)} + 5 * {exact(terms)}) end")


def audit(docs: DataFrame, least: int = 30, first: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the sources of each language apart.

    Terms are runs of letters, A-Z lower-cased; a language keeps those that ``least`` of its documents have. A term's share in a group is
    ``share`` of its count. Part 'pair': item is another source of the language and value the sum of the differences of all terms' shares.
    Part 'term': the ``first`` terms of a group whose share lies furthest above that in the language. Equal values are ranked by item. Null texts, languages and sources are
    read as ''; every row is a document, repeated ones too; groups without terms are compared; without kept terms a pair's value is 0. Other columns aren't looked at.
    """
    counts = common.saved(term_counts(docs), "terms")
    real = counts.where("term != ''")
    cell = F.struct("source", "count")
    terms = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.sort_array(F.collect_list(cell)).alias("cells"))
    terms = common.saved(terms.where(F.col("docs") >= least).select("lang", "term", "total", "cells"), "kept")
    long = terms.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.count")
    sums = long.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.saved(groups.fillna(0, ["size", "v", "whole"]), "groups")

    one, two = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("na"), "v"), groups.select("lang", F.col("source").alias("b"), F.col("size").alias("nb"))
    pairs = one.join(two, "lang").where("a < b")
    cells = joint_histograms(terms, pairs.select("lang", "a", "b")).join(pairs, ["lang", "a", "b"])
    value = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("n") * F.abs(share("x", "na", "v") - share("y", "nb", "v"))).alias("value"))
    value = common.saved(pairs.select("lang", "a", "b").join(value, ["lang", "a", "b"], "left").fillna(0, ["value"]), "values")
    both = value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(value.select("lang", "b", "a", "value"))
    over = long.join(groups, ["lang", "source"]).withColumn("value", share("count", "size", "v") - share("total", "whole", "v")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    ranked = [rows.withColumn("part", F.lit(part)).select(*columns, rank) for part, rows in (("pair", both), ("term", over.withColumnRenamed("term", "item")))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= first))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents, compared within each language."""
    return audit(common.table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {
    "op12_source_divergence": r"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
w as (select id, lang, source, unnest(ws) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct id) >= 30),
l as (select lang, count(*)::hugeint as v, sum(total)::hugeint as whole from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
g as (select distinct lang, source from d),
z as (select lang, source, sum(n)::hugeint as size from c group by all),
s as (select g.lang, g.source, term, coalesce(n, 0) as n, total, 1 + (1000000000 * (coalesce(n, 0)::hugeint + 5)) // (coalesce(size, 0) + 5 * v) as p, 1 + (1000000000 * (total::hugeint + 5)) // (whole + 5 * v) as q
  from g join k using (lang) join l using (lang) left join c using (lang, source, term) left join z on z.lang = g.lang and z.source = g.source),
u as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from s x join s y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
r as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source left join u on u.lang = x.lang and u.source = x.source and u.item = y.source
  union all select lang, source, 'term', term, (p - q)::bigint from s where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from r qualify part = 'pair' or rank <= 50"""
}
