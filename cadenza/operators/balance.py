"""Exact nearest neighbours in blocks, and what rests on them: synthetic minority rows, cleaning by neighbours' vote, and the features made from both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import written

from . import ranks, split, stats
from .moments import matrix

#: Rows of a group in one block, and distances a task holds at once.
BLOCK, CELLS = 32_768, 2_000_000
#: Tasks that a group is dealt over at least, if each of them has SOME rows to ask for.
TASKS, SOME = 48, 1_024
#: Neighbours whose least distance stands for all of them when a row's reach is bounded.
STRIDE = 64


class Block:
    """Rows that others are compared with: their ids, their places in order of these, and their vectors."""

    def __init__(self, ids: pa.Array, y: np.ndarray):
        self.ids, self.y = ids, y
        names = ids.to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        self.place = np.empty(len(order), int)
        self.place[order] = np.arange(len(order))
        with np.errstate(all="ignore"):
            self.mean = y.mean(0)
            self.apart = np.ascontiguousarray((y - self.mean).T)
            self.squares = (self.apart**2).sum(0)
            self.reach = np.sqrt(self.squares.max())
            self.raw = np.abs(y).max(initial=0)

    def distances(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the pairs (rows, at), summed by element: the same sums whatever the block."""
        d = np.zeros(len(rows))
        for c in range(x.shape[1]):
            d += (x[rows, c] - self.y[at, c]) ** 2
        return d

    def near(self, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the block, d) of the k nearest of each row of x, but for its own place (-1: none); by row, d and id.

        A product of matrices bounds which rows can be among the k nearest: distances from it are wrong by less than ``slack``, and k groups of
        STRIDE rows, or k rows, that reach no farther bound the k-th. Only what's within that is measured exactly.
        """
        n, m = len(x), len(self.y)
        with np.errstate(all="ignore"):
            z = x - self.mean
            size = (z * z).sum(1)
            far = np.sqrt(size) + self.reach
            moved = 8 * np.finfo(float).eps * (np.abs(x).max(1, initial=0) + self.raw) * np.sqrt(x.shape[1])  # what the shift by the mean rounds away, at most
            slack = 4 * (x.shape[1] + 8) * np.finfo(float).eps * far**2 + 2 * moved * far + moved**2
            d = z @ self.apart
            d *= -2
            d += self.squares
            d += size[:, None]
            sure = np.isfinite(slack) & np.isfinite(self.squares).all()
            mine = np.flatnonzero(own >= 0)
            d[mine, own[mine]] = np.inf
            whole = m // STRIDE * STRIDE
            least = np.concatenate([d[:, :whole].reshape(n, STRIDE, -1).min(1), d[:, whole:]], 1) if whole >= k * STRIDE else d
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(n, np.inf)
            limit = np.where(sure, bound + 2 * slack, np.inf)
            close = (d <= limit[:, None]) | ~sure[:, None]
            close[mine, own[mine]] = False
            rows, at = np.nonzero(close)
            found = self.distances(x, rows, at)
        kept = found < np.inf
        rows, at, found = rows[kept], at[kept], found[kept]
        order = np.lexsort((self.place[at], found, rows))
        rows, at, found = rows[order], at[order], found[order]
        first = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - first < k
        return rows[kept], at[kept], found[kept]


def nearest(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, grp, near array<struct<d, id>>) of rows (id, grp, v): the k other rows of the same group at the least Euclidean distance, exactly.

    d is the squared distance; equal ones are ordered by id. A group is cut into blocks and its rows into shares that ask; each block meets each share in a task of its
    own, which gives the share's rows their k nearest of the block; these lists are merged. Ids tell rows apart; null groups are a group; vectors are of one length, without
    nulls. Rows alone in a group have an empty list. Every two rows are compared, so the work grows with the square of a group.
    """
    rows = rows.select("id", "grp", F.col("v").cast("array<double>").alias("v"))
    blocks = F.ceil(F.count("*") / block)
    shares = F.greatest(blocks, F.least(F.ceil(F.count("*") / SOME), F.ceil(F.lit(TASKS) / blocks)))
    sizes = rows.groupBy("grp").agg(blocks.cast("int").alias("blocks"), shares.cast("int").alias("shares"))  # a row for each group
    away, many, most, a, b, kind = ranks.fresh(rows.columns, "g", "blocks", "shares", "a", "b", "kind")
    placed = rows.join(sizes.toDF(away, many, most), F.col("grp").eqNullSafe(F.col(away))).drop(away)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = placed.select("id", "grp", "v", own(many).alias(a), every(most).alias(b), F.lit(0).alias(kind))
    asked = placed.select("id", "grp", "v", every(many).alias(a), own(most).alias(b), F.lit(1).alias(kind))
    parts = max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.union(asked).repartition(parts, "grp", a, b).sortWithinPartitions("grp", a, b, kind)
    kind_of = rows.schema["id"].dataType.simpleString()

    def lists(base: Block, ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = pc.index_in(ids, value_set=base.ids).fill_null(-1).to_numpy(zero_copy_only=False)
        step = max(1, CELLS // max(1, len(base.y)))
        for at in range(0, len(ids), step):
            some = x[at : at + step]
            row, there, d = base.near(some, own[at : at + step], k)
            ends = np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(d, pa.float64()), base.ids.take(pa.array(there, pa.int64()))], names=["d", "id"])
            yield pa.RecordBatch.from_arrays([ids.slice(at, step), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["id", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, y, met = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = [0, *np.flatnonzero(ranks.changes([batch.column(c) for c in (1, 3, 4, 5)])).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                some = batch.slice(s, e - s)
                key = [some.column(c)[0].as_py() for c in (1, 3, 4)]
                if key != now:
                    now, ids, y, met = key, [], [], None
                if some.column(5)[0].as_py() == 0:
                    ids.append(some.column(0))
                    y.append(matrix(some.column(2)))
                elif not ids:  # no row of the group is in this block
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([[]] * (e - s), near_type)], names=["id", "near"])
                else:
                    if met is None:
                        met, y = Block(pa.concat_arrays(ids), np.concatenate(y)), []
                    yield from lists(met, some.column(0), matrix(some.column(2)))

    near_type = pa.list_(pa.struct([("d", pa.float64()), ("id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind_of, pa.string()))]))
    met = dealt.mapInArrow(run, f"id {kind_of}, near array<struct<d: double, id: {kind_of}>>")
    best = met.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.join(rows.select("id", "grp"), "id").select("id", "grp", "near")


def _draw(seed: int, *columns: str):
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def smote(rows: DataFrame, key: str, label: str, column: str, k: int = 5, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, copy, label, v): all rows as copy 0 and, for each class but the largest, synthetic rows up to the largest one's size.

    A synthetic row lies between a row and one of its k nearest of the class, at a place that the hash of key and copy draws, so it's the same at each run; a class's
    rows take turns in an order drawn the same way. A class of one row repeats it. Rows with a null key, label, vector or element are left out; keys tell rows apart.
    """
    v = F.col(column).cast("array<double>")
    whole = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))
    source = written(whole.select(F.col(key).alias("id"), F.col(label).alias("grp"), v.alias("v")), "vectors")
    placed = ranks.running(source, ["grp"], ranks.shuffled(seed, "id"), "place", "many")
    most = source.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))  # one row
    lack = F.col("most") - F.col("many")
    turns = F.floor(lack / F.col("many")) + (F.col("place") < lack % F.col("many")).cast("int")
    wanted = placed.join(F.broadcast(most)).withColumn("turns", turns.cast("int")).where("turns > 0").select("id", "grp", "v", "turns")
    near = nearest(source.join(wanted.select("grp").distinct(), "grp", "left_semi"), k, block)
    made = wanted.join(near.select("id", "near"), "id").withColumn("copy", F.explode(F.sequence(F.lit(1), "turns")))
    pick = F.floor(_draw(seed + 1, "id", "copy") * F.size("near")).cast("int")
    made = made.withColumn("mate", F.when(F.size("near") > 0, F.get("near", pick)["id"]).otherwise(F.col("id"))).withColumn("gap", _draw(seed + 2, "id", "copy"))
    mates = source.select(F.col("id").alias("mate"), F.col("v").alias("w"))
    between = F.zip_with("v", "w", lambda x, y: x + F.col("gap") * (y - x))
    both = source.select("id", F.lit(0).alias("copy"), "grp", "v").union(made.join(mates, "mate").select("id", "copy", "grp", between))
    return both.select(F.col("id").alias(key), "copy", F.col("grp").alias(label), F.col("v").alias(column))


def edited(rows: DataFrame, keys: list[str], label: str, column: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """The rows whose k nearest of all rows have the same label as they. Keys together tell rows apart."""
    name = F.concat_ws("+", *(F.col(c).cast("string") for c in keys))
    own, = ranks.fresh(rows.columns, "row_name")
    named = written(rows.withColumn(own, name), "named")
    near = nearest(named.select(F.col(own).alias("id"), F.lit(0).alias("grp"), F.col(column).alias("v")), k, block)
    votes = near.select("id", F.explode(F.col("near.id")).alias("mate")).join(named.select(F.col(own).alias("mate"), F.col(label).alias("vote")), "mate")
    against = votes.join(named.select(F.col(own).alias("id"), F.col(label).alias("own")), "id").where("vote != own").select(F.col("id").alias(own)).distinct()
    return named.join(against, own, "left_anti").drop(own)


def smote_enn(rows: DataFrame, key: str, label: str, column: str, k: int = 5, votes: int = 3, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, copy, label, v): ``smote``, then ``edited`` over all rows, synthetic ones too."""
    return edited(smote(rows, key, label, column, k, seed, block), [key, "copy"], label, column, votes, block)


def prepared(rows: DataFrame, key: str, label: str, column: str, part: float = 0.95, seed: int = 1) -> DataFrame:
    """(key, copy, label, z): balanced by ``smote_enn``, on the principal axes that hold ``part`` of the variance, then scaled, in that order. No rows for no rows."""
    balanced = written(smote_enn(rows, key, label, column, seed=seed), "balanced")
    if balanced.isEmpty():
        return balanced.select(key, "copy", label, F.col(column).alias("z"))
    mean, axes = stats.principal(balanced, column, part)
    spread = stats.projected(balanced, column, mean, axes).select(key, "copy", label, "z")
    return split.standard_scaled(spread, [key, "copy", label], [], "z")
