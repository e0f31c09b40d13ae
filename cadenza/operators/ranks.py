"""Places and running sums within groups, exactly, without a task that holds a whole group.

Rows are dealt by ranges of (group, order), so a large group lies in many parts, and each part is summed along its order; what
a part lacks are the sums of the parts before it, a row for each group and part. Only those are brought together by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources.tables import written


def fresh(columns: list[str], *names: str) -> list[str]:
    """For each name one like it that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's group differs from that of the row before; null is a group's name like any other."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        same = pc.equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
        out[1:] |= ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
    return out


def running(rows: DataFrame, group: list[str], order: list[Column | str], before: str, total: str, weight: str | None = None) -> DataFrame:
    """rows with ``before``, the weights of the group's earlier rows in order, and ``total``, those of all its rows; both long.

    Without a weight rows count 1: ``before`` is a row's place from 0 on. The order should tell a group's rows apart: equal ones are
    placed as they come. Null groups are groups; null weights count as 0. Group columns are numbers, strings, dates or booleans.
    """
    w, part, own = fresh(rows.columns, "w", "part", "own")
    made = rows.withColumn(w, F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0)))
    by = [*map(F.col, group), *(F.col(o) if isinstance(o, str) else o for o in order)]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = made.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = [dealt.columns.index(g) for g in group]
    place = dealt.columns.index(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        last, held = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = changes([batch.column(k) for k in at]) if at else np.zeros(n, bool)
            key = [batch.column(k)[0].as_py() for k in at]
            add = batch.column(place).to_numpy().astype(np.int64)
            sums = np.cumsum(add) - add
            starts = np.flatnonzero(change)
            base = np.zeros(n, np.int64)
            base[: starts[0] if len(starts) else n] = held if key == last else 0
            for a, b in zip(starts.tolist(), [*starts.tolist()[1:], n]):
                base[a:b] = -sums[a]
            found = base + sums
            last, held = [batch.column(k)[n - 1].as_py() for k in at], int(found[-1] + add[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, number), pa.int32()), pa.array(found)], names=[*batch.schema.names, part, own])

    schema = T.StructType([*dealt.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(own, T.LongType())])
    summed = written(dealt.mapInArrow(run, schema), "ranks")  # ranges are drawn anew by each reading, so they are fixed here
    sums = summed.groupBy(*group, part).agg(F.sum(w).alias(total))  # a row for each group and part
    along = Window.partitionBy(*group).orderBy(part)
    offsets = sums.withColumn(before, F.sum(total).over(along) - F.col(total)).withColumn(total, F.sum(total).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    away = fresh([*rows.columns, *summed.columns, before, total], *(f"g{k}" for k in range(len(group))), "p")
    offsets = offsets.toDF(*away, *offsets.columns[len(away) :])
    same = F.col(part) == F.col(away[-1])
    for g, a in zip(group, away):
        same = same & F.col(g).eqNullSafe(F.col(a))
    return summed.join(offsets, same).select(*rows.columns, (F.col(own) + F.col(before)).alias(before), total)


def shuffled(seed: int, *columns: str) -> list[Column]:
    """An order that a seed alone draws: by hash, then by the columns."""
    return [F.xxhash64(F.lit(seed), *columns), *map(F.col, columns)]
