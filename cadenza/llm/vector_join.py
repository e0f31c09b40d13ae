"""Near duplicates among vectors by an inverted multi-index.

Unit vectors are cut into halves, each with a codebook of its own; a vector's cell is the pair of its
halves' nearest centroids, so two books of k words make k * k cells. A vector visits cells by the sum of its halves' squared
distances to the borders of their centroids' regions, the multi-sequence order, and stops beyond a reach that is measured on the sample the books are fitted on:
vectors turned in random directions to just the wanted similarity lie in the cells visited up to it as often as the target recall asks for.
Each pair of cells is looked at from the lesser one, and each pair of vectors that meets is verified once.

Equal vectors are one class. A cell of more than BLOCK classes is dealt in blocks, each compared with each other in a task of
its own. Pairs never leave a task: numbers of links are summed and links are kept as few edges that span the same components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Vectors that the books are fitted on, turned copies of each for the reach, and rounds of fitting.
SAMPLE, TURNS, ROUNDS = 10_000, 4, 12
#: Classes that a label's cell should hold, and words of a book at the most.
CELL, WORDS = 256, 256
#: Classes of a cell in one task, and rows multiplied with them at once.
BLOCK, CHUNK = 4_096, 512
#: Cosines this near to the threshold are taken again from exact sums.
CLOSE = 1e-9


def units(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; rows are finite and not all zero."""
    x = raw / np.abs(raw).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1), 0)


def fitted(x: np.ndarray, many: int, seed: int) -> np.ndarray:
    """A codebook of at most ``many`` words for rows x: k-means from distinct rows."""
    start = np.unique(x, axis=0)
    book = start[np.random.default_rng(seed).permutation(len(start))[:many]].copy()
    for _ in range(ROUNDS):
        near = _squares(x, book).argmin(1)
        size = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[size > 0] = total[size > 0] / size[size > 0, None]
    return book


class Index:
    """Two codebooks and the reach up to which a vector visits cells."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float, recall: float):
        self.dim = sample.shape[1]
        half = self.dim // 2
        self.books = [fitted(sample[:, :half], words, 1), fitted(sample[:, half:], words, 2)]
        self.gaps = [np.sqrt(_squares(b, b)) for b in self.books]
        some = np.repeat(sample[:2_000], TURNS, axis=0)
        turn = np.random.default_rng(3).normal(size=some.shape)
        turn -= (turn * some).sum(1, keepdims=True) * some
        turn /= np.maximum(np.sqrt((turn * turn).sum(1, keepdims=True)), 1e-300)
        (_, u), (_, v) = self._borders(some)
        a, b = self.cells(cosine * some + math.sqrt(1 - cosine * cosine) * turn)
        rows = np.arange(len(some))
        self.reach = float(np.quantile(u[rows, a] + v[rows, b], recall, method="higher")) + 1e-12

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.dim // 2], x[:, self.dim // 2 :]]

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        return [_squares(h, b).argmin(1) for h, b in zip(self._halves(x), self.books)]

    def _borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the own word of each row and its squared distance to the region of each word."""
        out = []
        for h, book, gap in zip(self._halves(x), self.books, self.gaps):
            square = _squares(h, book)
            own = square.argmin(1)
            apart = np.maximum(2 * gap[own], 1e-300)
            far = ((square - square[np.arange(len(h)), own][:, None]) / apart) ** 2
            far[np.arange(len(h)), own] = 0
            out.append((own, np.where(gap[own] > 0, far, 0)))
        return out

    def visits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell) of the cells after its own that each row visits, nearest first, once own cells are given."""
        (a, u), (b, v) = self._borders(x)
        size = len(self.books[1])
        own = a * size + b
        yield np.arange(len(x)), own
        first, second = np.argsort(u, 1, kind="stable"), np.argsort(v, 1, kind="stable")
        u, v = np.take_along_axis(u, first, 1), np.take_along_axis(v, second, 1)
        for i in range(u.shape[1]):  # the i-th nearest word of the first half with a run of nearest words of the second
            rows = np.flatnonzero(u[:, i] <= self.reach)
            if not len(rows):
                break
            for j in range(v.shape[1]):
                rows = rows[u[rows, i] + v[rows, j] <= self.reach]
                if not len(rows):
                    break
                cell = first[rows, i] * size + second[rows, j]
                later = cell > own[rows]
                if later.any():
                    yield rows[later], cell[later]


def _signed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, sig, vec) of each row; sig and vec are null where it links with nothing."""
    label = vectors.schema["label"].dataType.simpleString()
    e = F.col("embedding")
    fit = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.when(fit, e.cast("array<double>")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            raw = [flat[a:b].tobytes() if b > a else None for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            sig = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int32()), pa.array(sig, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "sig", "vec"])

    return rows.mapInArrow(run, f"vec_id long, label {label}, dim int, sig binary, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _placed(classes: DataFrame, index: Index | None) -> DataFrame:
    """Rows (label, dim, cell, kind, cid, copies, vec): each class in its own cell, of kind 0, and in those that it visits, of kind 1.

    Classes of another dimension than the index's are all in the cell -1.
    """
    shared = classes.sparkSession.sparkContext.broadcast(index)  # 2 * WORDS words of half a vector, and WORDS ** 2 gaps
    names = ["label", "dim", "cell", "kind", "cid", "copies", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            dims = batch.column(1).to_numpy()
            other = np.flatnonzero(dims != index.dim)
            rows = np.flatnonzero(dims == index.dim)
            parts = [(other, np.full(len(other), -1), 0)] if len(other) else []
            for at in range(0, len(rows), 2_000):
                some = rows[at : at + 2_000]
                x = units(_matrix(batch.column(4).take(pa.array(some)), index.dim))
                for kind, (row, cell) in enumerate(index.visits(x)):
                    parts.append((some[row], cell, min(kind, 1)))
            for row, cell, kind in parts:
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(cell, pa.int64()), pa.array(np.full(len(row), kind), pa.int32()), *own.columns[2:]], names=names)

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dim", "cid", "copies", "vec").mapInArrow(run, f"label {label}, dim int, cell long, kind int, cid long, copies long, vec binary")


class _Cell:
    """The classes of one block of a cell, what they link to and how they hang together."""

    def __init__(self, dim: int, cosine: float):
        self.dim, self.cosine = dim, cosine
        self.parts: list[tuple] = []
        self.closed = False

    def add(self, cid: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> None:
        self.parts.append((cid, copies, raw))

    def close(self) -> Iterator[pa.RecordBatch]:
        """Compares the block's own classes."""
        self.closed = True
        if not self.parts:
            return
        self.cid, self.copies, self.raw = (np.concatenate(k) for k in zip(*self.parts))
        self.unit, self.root = units(self.raw), np.arange(len(self.cid))
        self.links = np.zeros(len(self.cid), np.int64)
        for at in range(0, len(self.cid), CHUNK):
            own = slice(at, at + CHUNK)
            near = self._near(self.unit[own], self.raw[own])
            near &= np.arange(len(self.cid)) > np.arange(at, at + len(near))[:, None]
            self.links[own] += near @ self.copies
            self.links += self.copies[own] @ near
            row, col = np.nonzero(near)
            yield from self._joined(row + at, col, np.zeros(0, np.int64))

    def against(self, cid: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compares further classes with the block's."""
        for at in range(0, len(cid) if self.parts else 0, CHUNK):
            own = slice(at, at + CHUNK)
            near = self._near(units(raw[own]), raw[own])
            row, col = np.nonzero(near)
            if len(row):
                self.links += copies[own] @ near
                yield _out(cid[own], None, near @ self.copies)
                yield from self._joined(row + len(self.cid), col, cid[own])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.closed:
            yield from self.close()
        if self.parts:
            yield _out(self.cid, None, self.links)

    def _near(self, unit: np.ndarray, raw: np.ndarray) -> np.ndarray:
        cosine = unit @ self.unit.T
        for i, j in zip(*np.nonzero(np.abs(cosine - self.cosine) < CLOSE)):
            x, y = raw[i] / np.abs(raw[i]).max(), self.raw[j] / np.abs(self.raw[j]).max()
            cosine[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))
        return cosine >= self.cosine

    def _joined(self, u: np.ndarray, v: np.ndarray, others: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges by which what is linked by (u, v) hangs together with what was before; places from the block's size on are in ``others``."""
        if not len(u):
            return
        names, root = np.concatenate([self.cid, others]), np.concatenate([self.root, len(self.cid) + np.arange(len(others))])
        before = root.copy()
        while True:
            least = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], least)
            np.minimum.at(new, root[v], least)
            new = new[new[root]]
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != before)
        self.root = root[: len(self.cid)]
        yield _out(names[moved], names[root[moved]], np.zeros(len(moved), np.int64))


def _out(u: np.ndarray, v: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    if v is None:
        u, n = u[n > 0], n[n > 0]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])


def _met(placed: DataFrame, cosine: float) -> DataFrame:
    """Rows (u, null, n): n vectors that class u links to, in one cell; rows (u, v, 0): edges that span what is linked."""
    key = ["label", "dim", "cell"]
    large = placed.where("kind = 0").groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    large = common.saved(large.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size"), "cells")  # at most a BLOCK-th of all classes
    rows = placed.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    last = F.col("blocks") - 1
    # A class of the cell is in its own block and visits the later ones; a visitor visits all.
    blocks = F.when(F.col("kind") == 0, F.sequence(own, last, F.lit(1))).otherwise(F.sequence(F.lit(0), last))
    rows = rows.withColumn("own", own).withColumn("block", F.explode(blocks)).withColumn("kind", F.when((F.col("kind") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1))
    names = [*key, "block", "kind", "cid", "copies", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if keys[a][:4] != now:
                    if cell is not None:
                        yield from cell.finish()
                    now, cell = keys[a][:4], _Cell(keys[a][1], cosine)
                some = batch.slice(a, b - a)
                part = some.column(5).to_numpy(), some.column(6).to_numpy(), _matrix(some.column(7), cell.dim)
                if keys[a][4] == 0:
                    cell.add(*part)
                else:
                    if not cell.closed:
                        yield from cell.close()
                    yield from cell.against(*part)
        if cell is not None:
            yield from cell.finish()

    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*names).repartition(n, *key, "block").sortWithinPartitions(*key, "block", "kind").mapInArrow(run, "u long, v long, n long")


def fit(classes: DataFrame, cosine: float, recall: float) -> Index | None:
    """An index fitted on the SAMPLE classes of least hash, for the dimension that most of them have; None without classes."""
    size = classes.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    rows = classes.select("dim", "vec", F.xxhash64("sig").alias("h"), "cid").orderBy("h", "cid").limit(SAMPLE).collect()
    if not rows:
        return None
    dims = [r.dim for r in rows]
    dim = max(sorted(set(dims)), key=dims.count)
    sample = units(np.frombuffer(b"".join(r.vec for r in rows if r.dim == dim), np.float64).reshape(-1, dim))
    return Index(sample, min(WORDS, max(2, round(math.sqrt(size.n / size.labels / CELL)))), cosine, recall)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, label, embedding).

    Vectors of the same label and dimension link if their cosine in double precision is ``cosine`` or more. Null labels, null, empty or zero vectors and
    such with null or non-finite elements link with nothing. n_links counts other rows, equal vectors too; component_id is the least vec_id reached
    over links, its own included; kept: it's the row's own. Every row is a vector, whether its vec_id is repeated or not; a row without one has
    the least of its component or null, and isn't kept. Of the links ``recall`` is the share aimed at, for links at the threshold itself; nearer vectors are found sooner. Other columns aren't looked at.
    """
    signed = common.saved(_signed(vectors), "vectors")
    found = signed.where("sig is not null").groupBy("label", "sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = common.saved(found.withColumn("cid", F.monotonically_increasing_id()), "classes")
    index = fit(classes, cosine, recall)
    plain = signed.select("vec_id", "label", "sig")
    if index is not None:
        met = common.saved(_met(common.saved(_placed(classes, index), "placed"), cosine), "met")
        links = met.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
        nodes = components(met.where("v is not null").select("u", "v"))
        joined = classes.select("cid", "label", "sig", "rep", "copies").join(links, "cid", "left").join(nodes.toDF("cid", "root"), "cid", "left")
        joined = joined.where("copies > 1 or links is not null").withColumn("root", F.coalesce("root", "cid"))
        joined = common.saved(joined, "joined")
        least = joined.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("many"))
        member = common.hot_left_join(joined, least, ["root"], F.col("cid"), "many")
        member = common.saved(member.select("label", "sig", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least", "copies"), "members")
        plain = common.hot_left_join(plain, member, ["label", "sig"], F.xxhash64("vec_id", F.monotonically_increasing_id()), "copies")
    else:
        plain = plain.withColumns({"links": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})
    component = F.coalesce("least", "vec_id")
    return plain.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op11_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of embeddings within each label at a cosine of 0.98."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_vector_join": op11_vector_join}
ORACLES = {
    "op11_vector_join": r"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.id where r.root < l.b),
m as (select id, min(root) as root from r group by id),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, e.vec_id = root as kept from embeddings e join m on m.id = e.vec_id left join n on n.a = e.vec_id"""
}
