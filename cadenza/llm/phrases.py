"""Collocations: phrases of up to four words that occur often and more often than their parts let expect.

A first pass adds every n-gram of every text to a count-min sketch; tasks' sketches are merged by
the executors. A sketch never counts too little, so no n-gram of ``least`` occurrences is lost when a second
pass looks only at those whose counters reach ``least`` and whose shorter parts survive as well; what
survives is counted exactly, by slice of texts first and then by Spark. Counters stop at ``least``: more isn't
asked of them, so one byte holds them.

The sketch's width follows the size of the texts up to MOST counters a row, which bounds the
broadcast. Beyond that it lets more rare n-grams through, at last all of them, which the exact count drops: the shuffle grows to that of
a plain count with sums by slice, the result doesn't change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words
from .shingles import _PLACE, _mixed

#: Words of the longest phrases.
LONGEST = 4
#: Bytes of text for each counter of a row of the sketch, and the fewest and most counters of a row (at one byte, DEPTH rows).
BYTES, LEAST, MOST, DEPTH = 32, 1 << 16, 1 << 26, 2
#: Blocks of a row in which sketches are merged.
BLOCKS = 32
#: Parts of the split scans that one task adds to one sketch, unless there are fewer parts than cores.
PARTS = 8
#: Parts that a language's candidates are dealt over before its first ranks are put together.
SALTS = 64
_KINDS = np.full(256, words.WORD, np.uint8)
_KINDS[[0x20, 0x09]] = words.GAP
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = words.BREAK
#: Words of a slice that are looked at together.
STRETCH = 500_000
#: Bytes of a slice for the sketch, to which the slices' sizes make no difference.
SKETCHED = 1_000_000


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _stretches(batch: pa.RecordBatch, size: int = words.SLICE) -> Iterator[tuple[pa.Array, words.Words, np.ndarray, np.ndarray, int, int]]:
    """(languages, words, each word's language, the distinct words' hashes, begin, end) of slices of a batch (text, lang).

    Phrases that begin in [begin, end) belong to a stretch, wherever they end.
    """
    langs = batch.column(1).dictionary_encode()
    number = langs.indices.to_numpy()
    for at, w in words.slices(batch.column(0), _KINDS, size):
        lang, hashed = number[at + w.text].astype(np.int64), w.hashes()
        for begin in range(0, len(w.code), STRETCH):
            yield langs.dictionary, w, lang, hashed, begin, min(begin + STRETCH, len(w.code))


def _hashed(w: words.Words, lang: np.ndarray, salt: np.ndarray, hashed: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to LONGEST the hashes of all runs of n words from each place, and which of these are phrases."""
    reach = min(end + LONGEST - 1, len(w.code))
    h = hashed[w.code[begin:reach]]
    own = salt[lang[begin:end]]
    joined = np.concatenate([w.joined[begin : reach - 1], np.zeros(LONGEST, bool)])
    size = end - begin
    rolled = np.zeros(size, np.uint64)
    whole = np.ones(size, bool)
    for n in range(LONGEST):
        part = h[n : n + size]
        rolled[: len(part)] += part * _PLACE[n]
        if n:
            whole = whole & joined[n - 1 : n - 1 + size]
        yield _mixed(rolled + own), whole


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for each language, that n-grams of several languages keep apart."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs.to_pylist()], np.uint64)


def _places(h: np.ndarray, width: int) -> list[np.ndarray]:
    """Where an n-gram is counted in each row of the sketch; width is a power of two."""
    mask = np.uint64(width - 1)
    return [((h >> np.uint64(32 * k)) & mask).astype(np.int64) for k in range(DEPTH)]


def width_for(docs: DataFrame, column: str = "text") -> int:
    """The sketch's width for a table: a power of two."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return min(MOST, max(LEAST, 1 << math.ceil(math.log2(size / BYTES + 1))))


def sketch(docs: DataFrame, least: int, width: int) -> np.ndarray:
    """DEPTH rows of ``width`` counters of the n-grams of docs (text, lang) that stop at ``least``, merged by the executors."""
    kind = np.min_scalar_type(least)
    size = width // BLOCKS
    schema = "block int, part int, counts binary"

    def rows(blocks: list[int], part: int, counts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(counts, pa.binary())], names=["block", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = np.zeros((DEPTH, width), kind)
        for batch in batches:
            for langs, w, lang, hashed, begin, end in _stretches(batch, SKETCHED):
                for h, whole in _hashed(w, lang, _salts(langs), hashed, begin, end):
                    for row, places in zip(own, _places(h[whole], width)):
                        at, times = np.unique(places, return_counts=True)
                        row[at] = np.minimum(row[at] + times, least)
        flat = own.reshape(DEPTH * BLOCKS, size)
        for block in range(DEPTH * BLOCKS):
            yield rows([block], TaskContext.get().partitionId(), [flat[block].tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            for block, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                more = np.frombuffer(counts, kind).astype(np.uint32)
                total[block] = np.minimum(total[block] + more, least) if block in total else more
        for block, sums in total.items():
            yield rows([block], part, [sums.astype(kind).tobytes()])

    parts = docs.rdd.getNumPartitions()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, parts // PARTS)
    tables = _source(docs).coalesce(tasks).mapInArrow(common.tidy(count), schema)
    for spread in ([math.isqrt(tasks)] if tasks > 64 else []) + [1]:
        tables = tables.repartition(DEPTH * BLOCKS * spread, "block", F.pmod("part", F.lit(spread))).mapInArrow(common.tidy(add), schema)
    out = np.zeros((DEPTH * BLOCKS, size), kind)
    for row in tables.collect():  # DEPTH * width counters in all
        out[row.block] = np.frombuffer(row.counts, kind)
    return out.reshape(DEPTH, width)


def counted(docs: DataFrame, least: int, table: np.ndarray) -> DataFrame:
    """(lang, phrase, f): exact counts of the n-grams of ``least`` occurrences or more, and of all words as the phrase ''."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    width = table.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, w, lang, hashed, begin, end in _stretches(batch):
                names = w.names()
                yield _counts(langs, np.arange(len(langs)), pa.array([""] * len(langs), pa.large_string()), np.bincount(lang[begin:end], minlength=len(langs)))
                at = alive = ids = None
                for n, (h, whole) in enumerate(_hashed(w, lang, _salts(langs), hashed, begin, end)):
                    if n:  # both shorter parts that begin here and at the next place survive, if that one is in this stretch
                        whole = whole & alive & np.append(alive[1:], True)
                    places = np.flatnonzero(whole)
                    ok = np.ones(len(places), bool)
                    for row, where in zip(shared.value, _places(h[places], width)):
                        ok &= row[where] >= least
                    at = places[ok]
                    alive = np.zeros(end - begin, bool)
                    alive[at] = True
                    last = w.code[begin + at + n]
                    keys, number = words.numbered((ids[at] if n else lang[begin + at]) * len(names) + last)
                    if not len(keys):
                        break
                    ids = np.zeros(end - begin, np.int64)
                    ids[at] = number
                    some = np.zeros(len(keys), np.int64)
                    some[number[::-1]] = at[::-1]  # a place of each
                    phrase = names.take(pa.array(w.code[begin + some]))
                    if n:
                        phrase = pc.binary_join_element_wise(phrase, *(names.take(pa.array(w.code[begin + some + k])) for k in range(1, n + 1)), pa.scalar(" ", pa.large_string()))
                    yield _counts(langs, lang[begin + some], phrase, np.bincount(number, minlength=len(keys)))

    found = _source(docs).mapInArrow(common.tidy(run), "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def _counts(langs: pa.Array, lang: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)).cast(pa.string()), phrase.cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "phrase", "f"])


def _exact(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, part: tuple[int, int] = (80, 100), first: int = 2000, width: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` best phrases of 2 to LONGEST words.

    a: occurrences of the phrase, ``least`` at the fewest; l, r: of the parts of its lowest-scoring cut, the first of such cuts; n: words of
    the language; score: floor(2000000 * a / (l + r)). Phrases inside a longer one that has part[0] / part[1] of their occurrences are dropped.
    Ties go to the larger a, then to the lesser phrase. Null and empty texts have no words, a null lang is 'und'; repeated rows count as
    often as they stand there. Other columns aren't looked at.
    """
    table = sketch(docs, least, width or width_for(docs))
    counts = common.saved(counted(docs, least, table), "phrases")
    known = counts.where("phrase != ''")
    split = F.split("phrase", " ")
    many = F.size("w")
    phrases = known.withColumn("w", split).where(many > 1).withColumnRenamed("f", "a")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), many - 1), lambda n: F.transform(F.sequence(F.lit(1), many - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    covers = phrases.where(many > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * part[1] < _exact("a") * part[0]))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), many - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, many - F.col("k")), " ").alias("tail"))
    # A part occurs wherever the phrase does, so both are among the counted ones.
    cuts = cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(counts.where("phrase = ''").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents."""
    return collocations(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {
    "op13_phrases": r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 5)) as k))),
n as (select lang, count(*) as n from g where k = 1 group by lang),
f as (select lang, phrase, k, count(*) as f from g group by all having count(*) >= 30),
c as (select lang, phrase, k, f as a, string_split(phrase, ' ') as ws from f where k > 1),
s as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as longer from (select lang, ws, a, m, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by all),
d as (select c.* from c left join s using (lang, phrase) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
u as (select lang, phrase, a, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:k], ' ') as tail from (select *, unnest(range(1, k)) as j from d)),
x as (select u.lang, u.phrase, a, j, l.f as l, r.f as r, ((2000000 * a::hugeint) // (l.f + r.f))::bigint as score from u join f l on l.lang = u.lang and l.phrase = head join f r on r.lang = u.lang and r.phrase = tail),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b join n using (lang) qualify rank <= 2000"""
}
