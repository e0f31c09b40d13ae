"""Jaccard join of documents on word n-grams, and the components of its links.

Prefix filtering, rare n-grams first: two sets whose similarity reaches the threshold share an
n-gram among the first n - ceil(t * n) + 1 of each, whatever order all sets are sorted in. The order
is by the frequency of the n-gram's hash bucket over all documents (a table of fixed size), then by
the hash, so prefixes hold rare n-grams. Documents meet on prefix n-grams; pairs are cut by length
and by the n-gram's positions, each pair of documents is kept once, the rest of the sets is bounded
by how they spread over 256 ranges of hashes (the suffix filter), and what is left is verified on
whole sets. Documents with equal sets are one class and join as one.

A group of documents that share a prefix n-gram isn't expanded into all its pairs when it's large:
first all of it is compared with one of its documents, that with the fewest rarer n-grams, which of
many near copies is the least edited one; then, as long as the group holds more than one component of
the links found so far, with four more, sixteen more, and so on, until all pairs that could link two
components have been compared; there the suffix filter comes before a pair is made. Components lose no link between different sets.
The rows of a hot group, one with a great share of all rows, are dealt over several tasks, and the documents
that they are compared with are copied to each of these: after the first one, documents that aren't in its
component, drawn by hash, until all of them have had their turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

#: Buckets of the frequency table (4 bytes each) and rows it's split into for merging.
BUCKETS = 1 << 20
BLOCKS = 16
#: Ranges of hashes for the suffix filter.
RANGES = 256
#: Groups of up to so many documents are compared pair by pair.
SMALL = 32
#: Rows of a hot group that go to one task; a group is hot above that and above a HOT_SHARE-th of the rows of such groups.
PART, HOT_SHARE = 512, 10_000
#: Bits of the filter by which sets are made for documents that are in a pair only.
FILTER_BITS = 1 << 23


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often n-grams of each hash bucket occur in all texts: BUCKETS counts, summed by the executors."""
    size = BUCKETS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in shingles.slices(batch.column(0)):
                found, _ = shingles.occurrences(*shingles.word_hashes(data, offsets), k)
                total += np.bincount((found >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        yield blocks(total, TaskContext.get().partitionId())

    def blocks(total: np.ndarray, part: int, which: list[int] | None = None) -> pa.RecordBatch:
        which = list(range(BLOCKS)) if which is None else which
        parts = [np.minimum(total[b * size : (b + 1) * size], 2**32 - 1).astype(np.uint32).tobytes() for b in which]
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([part] * len(which), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            for block, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        for block, sums in total.items():
            data = np.minimum(sums, 2**32 - 1).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    tables = docs.select("text").mapInArrow(common.tidy(count), schema)
    tasks = common.partitions_of(docs)
    for width in ([math.isqrt(tasks)] if tasks > 64 else []) + [1]:  # sums of sums: a task adds up what it streams
        tables = tables.repartition(BLOCKS * width, "block", F.pmod("part", F.lit(width))).mapInArrow(common.tidy(add), schema)
    out = np.zeros(BUCKETS, np.int64)
    for row in tables.collect():  # BLOCKS rows of 4 * BUCKETS / BLOCKS bytes
        out[row.block * size : (row.block + 1) * size] += np.frombuffer(row.counts, np.uint32)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def profiles(docs: DataFrame, k: int, num: int, den: int, table: np.ndarray) -> DataFrame:
    """Of each document: doc_id, n (set size), sig (digest of the set), prefix (rare first), spread (RANGES counts up to 255), rare, x (a hash of the text).

    rare: how many of the prefix's n-grams lie in buckets of up to PART occurrences; groups of these are never hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 4 * BUCKETS bytes
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("prefix", pa.list_(pa.int64())), ("spread", pa.binary()), ("rare", pa.int32()), ("x", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            n, sig, prefix, bounds, spread, rare = [], [], [], [0], [], []
            for _, one in shingles.sets(batch.column(1), k):
                size = len(one)
                m = size - -(-num * size // den) + 1 if size else 0
                often = count[(one >> np.uint64(44)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[:m]
                rare.append(int((often[order] <= PART).sum()))
                n.append(size)
                sig.append(hashlib.blake2b(one, digest_size=16).digest())
                prefix.append(one[order])
                bounds.append(bounds[-1] + m)
                spread.append(np.minimum(np.bincount((one >> np.uint64(56)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes())
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), lists, pa.array(spread, pa.binary()), pa.array(rare, pa.int32()), batch.column(2)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("x")).mapInArrow(common.by_text(run, 1), "doc_id long, n int, sig binary, prefix array<bigint>, spread binary, rare int, x long")


def _matrix(spreads: pa.Array) -> np.ndarray:
    """Spreads as rows of RANGES counts."""
    return np.frombuffer(b"".join(spreads.to_pylist()), np.uint8).reshape(-1, RANGES)


def _near(x: np.ndarray, y: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """The suffix filter: elements that only one of two sets has number the ranges' differences at least."""
    differ = np.abs(x.astype(np.int16) - y).sum(1)
    return (both - differ) * (num + den) >= 2 * num * both


def _kept(x: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs of rows i and j of x pass the filters."""
    n, m = x["n"][i], x["n"][j]
    p, q = x["pos"][i], x["pos"][j]
    ok = (x["comp"][i] != x["comp"][j]) & ~((p > 0) & (q > 0) & (x["prev"][i] == x["prev"][j]))
    ok &= den * np.minimum(n, m) >= num * np.maximum(n, m)
    ok &= (np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1)) * (num + den) >= num * (n + m)
    if "spread" in x:
        left = np.flatnonzero(ok)
        for at in range(0, len(left), 20_000):
            k = left[at : at + 20_000]
            ok[k] = _near(x["spread"][i[k]], x["spread"][j[k]], n[k] + m[k], num, den)
    return ok


def _met(s: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    """Pairs, or (s, a, null)."""
    if b is None:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(a), pa.nulls(len(a), pa.int64())], names=["s", "a", "b"])
    return pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["s", "a", "b"])


def _pairs(rows: DataFrame, num: int, den: int, first: int, last: int, small: int) -> DataFrame:
    """Pairs (a < b) of the groups of rows (s, prev, rep, n, pos, comp); see the module's text.

    Groups of more than ``small`` rows: rows of rank first..last - 1 against all later rows; each of
    their rows is also given as (s, a, null). Rows of equal comp aren't paired, nor such with the
    same n-gram before s in their prefixes: they've met there. With a column spread the suffix filter holds.
    """
    names = ["s", "prev", "rep", "n", "pos", "comp", *(["spread"] if "spread" in rows.columns else [])]
    keep, out = partial(_kept, num=num, den=den), _met

    def all_pairs(x: dict, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for size in np.unique(sizes[sizes > 1]):
            u, v = np.triu_indices(size, 1)
            own = starts[sizes == size]
            step = max(1, 200_000 // len(u))
            for at in range(0, len(own), step):
                part = own[at : at + step, None]
                i, j = (part + u).ravel(), (part + v).ravel()
                ok = keep(x, i, j)
                if ok.any():
                    yield out(x["s"][i[ok]], x["rep"][i[ok]], x["rep"][j[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # rows of the group that the last batch ended in
        large = 0  # how many rows of that group are past, if it's a large one
        pivots: dict | None = None

        def against(x: dict, rank: int) -> Iterator[pa.RecordBatch]:
            """Rows x of a large group, of which rank rows came before."""
            nonlocal pivots
            yield out(x["s"], x["rep"], None)
            lo, hi = max(0, first - rank), max(0, last - rank)
            new = {k: v[lo:hi] for k, v in x.items()}
            pivots = new if pivots is None else {k: np.concatenate([pivots[k], new[k]]) for k in names}
            old = len(pivots["s"]) - len(new["s"])
            both = {k: np.concatenate([pivots[k], x[k]]) for k in names}
            size = len(x["s"])
            for p in range(len(pivots["s"])):
                begin = 0 if p < old else lo + p - old + 1  # later rows only
                j = len(pivots["s"]) + np.arange(begin, size)
                ok = keep(both, np.full(len(j), p), j)
                if ok.any():
                    yield out(x["s"][: ok.sum()], np.full(ok.sum(), pivots["rep"][p]), both["rep"][j[ok]])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names) if k != "spread"}
            if "spread" in names:
                x["spread"] = _matrix(batch.column(6))
            if held is not None:
                x = {k: np.concatenate([held[k], x[k]]) for k in names}
                held = None
            if large:
                same = int(np.searchsorted(x["s"] != large_s, True)) if (x["s"] != large_s).any() else len(x["s"])
                if same:
                    yield from against({k: v[:same] for k, v in x.items()}, large)
                    large += same
                if same == len(x["s"]):
                    continue
                large, pivots = 0, None
                x = {k: v[same:] for k, v in x.items()}
            starts = np.flatnonzero(np.concatenate([[True], x["s"][1:] != x["s"][:-1]]))
            sizes = np.diff(np.append(starts, len(x["s"])))
            tail = starts[-1]
            yield from all_pairs(x, starts[:-1][sizes[:-1] <= small], sizes[:-1][sizes[:-1] <= small])
            for at, size in zip(starts[:-1][sizes[:-1] > small].tolist(), sizes[:-1][sizes[:-1] > small].tolist()):
                pivots = None
                yield from against({k: v[at : at + size] for k, v in x.items()}, 0)
            pivots = None
            rest = {k: v[tail:] for k, v in x.items()}
            if sizes[-1] > small:
                large_s = rest["s"][0]
                yield from against(rest, 0)
                large = int(sizes[-1])
            else:
                held = rest
        if held is not None:
            yield from all_pairs(held, np.zeros(1, np.int64), np.array([len(held["s"])]))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*names).repartition(n, "s").sortWithinPartitions("s", "pos", F.xxhash64("rep"), "rep")
    return dealt.mapInArrow(common.tidy(run), "s long, a long, b long")


def _drawn(rows: DataFrame) -> DataFrame:
    """rows with u, a number from 0 to 1 drawn by hash of rep."""
    return rows.withColumn("u", F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def _main(rows: DataFrame) -> DataFrame:
    """(s, main): the component of each group's first document, that of least pos."""
    return _drawn(rows).groupBy("s").agg(F.min(F.struct("pos", "u", "rep", "comp")).alias("p")).select("s", F.col("p.comp").alias("main"))


def _hot_pairs(rows: DataFrame, hot: DataFrame, num: int, den: int, first: int | None, last: int) -> DataFrame:
    """As ``_pairs`` for the groups of hot (s, size, others), each dealt over size / PART tasks or so.

    first = None: the groups' rows against their first document. Else against documents outside of the first one's component
    whose u lies in [first, last) / others. A pair of two such documents is compared in the round of the lesser u at
    the latest, so once last reaches ``others``, how many of them there were at the start, all pairs
    over two components have been compared.
    """
    names = ["s", "prev", "rep", "n", "pos", "comp", *(["spread"] if "spread" in rows.columns else [])]
    own = _drawn(rows.select(*names)).join(F.broadcast(hot), "s").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    if first is None:
        least = own.groupBy("s").agg(F.min(F.struct("pos", "u", "rep", *[c for c in own.columns if c not in ("s", "pos", "u", "rep")])).alias("p"))
        pivots = least.select("s", "p.*").withColumn("u", F.lit(-1.0))
    else:
        main = common.saved(_main(rows), "main")  # a row for each hot group
        pivots = own.join(F.broadcast(main), "s").where(f"comp != main and u * others >= {first} and u * others < {last}").drop("main")
    columns = [*names, "u", "kind", "salt"]
    copies = pivots.withColumns({"kind": F.lit(0), "salt": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    dealt = copies.select(*columns).union(own.withColumns({"kind": F.lit(1), "salt": F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")}).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(columns) if k != "spread"}
            if "spread" in names:
                x["spread"] = _matrix(batch.column(6))
            change = (x["s"][1:] != x["s"][:-1]) | (x["salt"][1:] != x["salt"][:-1]) | (x["kind"][1:] != x["kind"][:-1])
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                part = {k: v[a:b] for k, v in x.items()}
                if (key := (int(x["s"][a]), int(x["salt"][a]))) != now:
                    now, pivots = key, []
                if x["kind"][a] == 0:
                    pivots.append(part)
                else:
                    yield from against(part, pivots)

    def against(x: dict, pivots: list[dict]) -> Iterator[pa.RecordBatch]:
        if first is None:
            yield _met(x["s"], x["rep"], None)
        size = len(x["s"])
        for p in pivots:
            for at in range(0, len(p["s"]), step := max(1, 200_000 // size)):
                some = {k: v[at : at + step] for k, v in p.items()}
                both = {k: np.concatenate([some[k], x[k]]) for k in some}
                many = len(some["s"])
                i, j = np.repeat(np.arange(many), size), many + np.tile(np.arange(size), many)
                ok = _kept(both, i, j, num, den)
                if ok.any():
                    yield _met(both["s"][i[ok]], both["rep"][i[ok]], both["rep"][j[ok]])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "s", "salt").sortWithinPartitions("s", "salt", "kind").mapInArrow(common.tidy(run), "s long, a long, b long")


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each id modulo FILTER_BITS."""
    words = ids.selectExpr(f"pmod(id, {FILTER_BITS}) div 64 as word", "shiftleft(1L, cast(pmod(id, 64) as int)) as bit")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # FILTER_BITS / 64 rows at the most
        out[row.word] = row.bits
    return out.view(np.uint64)


def _sets(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """(id, grams) of the documents that the filter lets through; grams: sorted 64-bit hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy() % FILTER_BITS
            wanted = (shared.value[ids // 64] >> (ids % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            wanted &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            where = np.flatnonzero(wanted)
            if not len(where):
                continue
            some = pa.RecordBatch.from_arrays(batch.columns, names=["id", "text"]).take(pa.array(where))
            found = [one.tobytes() for _, one in shingles.sets(some.column(1), k)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], names=["id", "grams"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.by_text(run, 1), "id long, grams binary")


def _pruned(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter lets through."""
    small = reps.select("rep", "n", "spread")
    one = pairs.join(small.toDF("a", "na", "spread_a"), "a")
    two = one.join(small.toDF("b", "nb", "spread_b"), "b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                a, b, na, nb, x, y = batch.slice(at, 20_000).columns
                ok = _near(_matrix(x), _matrix(y), na.to_numpy().astype(np.int64) + nb.to_numpy(), num, den)
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok))

    return two.select("a", "b", "na", "nb", "spread_a", "spread_b").mapInArrow(common.tidy(prune), "a long, b long")


def _needed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that some pair needs. Spark broadcasts the pairs' ids, a saved table, if it's small: rounds of few pairs don't move all sets."""
    ids = common.saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    return common.saved(sets.join(ids, "id", "left_semi"), "needed")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    full = pairs.join(sets.toDF("b", "grams_b"), "b").join(sets.toDF("a", "grams_a"), "a").select("a", "b", "grams_a", "grams_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(den * same >= num * (len(both) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.mapInArrow(common.tidy(run), "a long, b long")


def linked(docs: DataFrame, k: int, num: int, den: int, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each row of docs (doc_id, text); see ``_linked``."""
    return _linked(docs, k, num, den, small).drop("text_hash")


def distinct(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows of docs whose text is in a component of which their doc_id is the least, and rows without a doc_id; all columns are kept.

    A text that links with no other is a component of its own, whatever other texts have its doc_id.
    """
    d, x = common.unused(docs.columns, "gone_id", "gone_text")
    gone = _linked(docs, k, num, den).where("component_id != doc_id").select(F.col("doc_id").alias(d), F.col("text_hash").alias(x)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(x)), "left_anti")


def _linked(docs: DataFrame, k: int, num: int, den: int, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64), a row for each row of docs (doc_id, text).

    Documents link if their sets' Jaccard similarity is num / den or more; component_id is the least
    doc_id reached over links, itself included. Empty and null texts have no shingles and link with
    nothing. Repeated rows give repeated results; texts whose least doc_id is the same are one
    document; a null doc_id links with nothing and has its class's component, or null. Other columns
    of docs are not looked at.
    """
    table = frequencies(docs, k)
    found = common.saved(profiles(docs, k, num, den, table), "profiles")
    reps = found.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("spread").alias("spread"), F.first("prefix").alias("prefix"), F.first("rare").alias("rare"))
    reps = common.saved(reps.where("rep is not null"), "classes")
    exploded = reps.select("rep", "n", "prefix", "rare", F.posexplode("prefix").alias("pos", "s"))
    rows = exploded.select("s", F.coalesce(F.get("prefix", F.col("pos") - 1), F.lit(0)).alias("prev"), "rep", "n", "pos", F.col("rep").alias("comp"), "rare")
    often = rows.where("pos >= rare").groupBy("s").agg(F.count("*").alias("size")).where(F.col("size") > PART)
    often = common.saved(often, "often")
    limit = (often.agg(F.sum("size")).first()[0] or 0) // HOT_SHARE
    hottest = common.saved(often.where(F.col("size") > limit), "hottest")  # less than HOT_SHARE groups
    rows = rows.drop("rare")
    met = _pairs(rows.join(F.broadcast(hottest), "s", "left_anti"), num, den, 0, 1, small)
    met = common.saved(met.union(_hot_pairs(rows, hottest.withColumn("others", F.lit(0)), num, den, None, 1)), "pairs")
    pairs = common.saved(met.where("b is not null and a != b").select("a", "b").distinct(), "candidates")
    near = common.saved(_pruned(pairs, reps, num, den), "near")
    hot_ids = met.where("b is null").select(F.col("a").alias("id"))
    bits = _filter(hot_ids.union(near.select("a")).union(near.select("b")))
    sets = common.saved(_sets(docs, k, bits), "sets")
    links = common.saved(_verified(near, sets, num, den), "links")
    hot = met.where("b is null").select("s").distinct()
    nodes = components(links.toDF("u", "v"))
    if not hot.isEmpty():
        rows = rows.drop("comp").join(hot, "s", "left_semi").join(reps.select("rep", "spread"), "rep")
        rows = common.saved(rows, "hot")
        known = others = None
        lo, hi = 1, 5  # ranks of the next pivots of groups
        low, high = 0, 16  # the same of hot groups
        while True:
            if known is None:
                known = rows.join(nodes.toDF("rep", "c"), "rep", "left").withColumn("comp", F.coalesce("c", "rep"))
                known = common.saved(known.drop("c"), "known")
            # Groups that lie in several components and have rows left to compare with.
            left = known.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x != y")
            left = common.saved(left.join(F.broadcast(hottest), "s", "left").select("s", "rows", "size"), "left")
            hot_known = common.saved(known.join(left.where("size is not null").select("s"), "s", "left_semi"), "hottest")
            if others is None:
                many = hot_known.join(F.broadcast(common.saved(_main(hot_known), "main")), "s").groupBy("s").agg(F.count_if(F.col("comp") != F.col("main")).alias("others"))
                others = common.saved(hottest.join(many, "s"), "others")
            cold, warm = left.where(f"size is null and rows > {lo + 1}").select("s"), others.where(f"others > {low}").join(left.select("s"), "s", "left_semi")
            if cold.isEmpty() and warm.isEmpty():
                break
            met = _pairs(known.join(cold, "s", "left_semi"), num, den, lo, hi, 1).where("b is not null")
            met = common.saved(met.union(_hot_pairs(hot_known, warm, num, den, low, high)), "pairs")
            lo, hi = hi, hi + 4 * (hi - lo)
            low, high = high, high + 4 * (high - low)
            if met.isEmpty():  # the pivots of this round are near none; later ones may be
                continue
            new = met.where("a != b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
            new = common.saved(new, "candidates")
            pairs = pairs.union(new)
            more = common.saved(_verified(new, _needed(new, sets), num, den), "links")
            if not more.isEmpty():
                links = links.union(more)
                nodes = components(nodes.toDF("u", "v").union(more.toDF("u", "v")))
                known = None
    classes = reps.select("sig", "rep", "copies").join(nodes.toDF("rep", "component"), "rep", "left")
    classes = classes.where("copies > 1 or component is not null").select("sig", F.coalesce("component", "rep").alias("component"), "copies")
    out = common.hot_left_join(found.select("doc_id", "n", "sig", "x"), common.saved(classes, "components"), ["sig"], F.col("doc_id"), "copies")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("x").alias("text_hash"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents under 4-word shingles and a similarity of 0.85."""
    return linked(common.table(spark, sf_dir, "documents"), 4, 85, 100)


QUERIES = {"op8_shingle_join": op8_shingle_join}
ORACLES = {
    "op8_shingle_join": r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.id where r.root < e.b),
m as (select id, min(root) as root from r group by id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.root as component_id from w left join n using (doc_id) join m on m.id = w.doc_id"""
}
