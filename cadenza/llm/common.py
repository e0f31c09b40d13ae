"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which all executors share.

    Where that setting is missing the folder of setCheckpointDir is taken; where that isn't set either, a
    local folder is made for a local master (tests on one machine), and a cluster is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.startswith("local"):
            root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    ensure_checkpoints(spark, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession, root: str) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of mapInArrow after which the worker gives the memory that it has freed back: Spark keeps idle workers, and what they hold counts for their executor."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            released()

    return run


#: Bytes of text that a step by slices takes at once.
TEXT_BYTES = 500_000


def slices(batch: pa.RecordBatch, at: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """batch in slices of about ``size`` bytes (TEXT_BYTES) of the texts in column ``at``, of one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + (size or TEXT_BYTES), "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def by_text(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A tidy step that gets its batches in ``slices``, so that what it makes of texts follows a slice, not Spark's 10,000 rows."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(part for batch in batches for part in slices(batch, at))

    return tidy(run)


def released() -> None:
    """Arrow's and, where the C library can do that, numpy's and Python's free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def unused(columns: list[str], *names: str) -> list[str]:
    """For each name one like it that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Schemes by which Hadoop knows stores that Arrow has under another one.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a URI and the path in it; a bare path is a local one.

    Arrow opens file, hdfs, viewfs, s3 (s3a and s3n are the same), gs and abfs[s], with the store's usual credentials;
    other schemes go through libhdfs, where that's installed, and else raise a ValueError.
    """
    scheme = urlparse(uri).scheme
    if not scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path
    try:
        return pafs.FileSystem.from_uri(ARROW_SCHEMES.get(scheme, scheme) + uri[len(scheme) :])
    except pa.ArrowInvalid:
        try:
            return pafs.HadoopFileSystem.from_uri(uri), urlparse(uri).path
        except (OSError, pa.ArrowInvalid, ValueError) as e:
            raise ValueError(f"{scheme}: is no store that Arrow or libhdfs opens here; set spark.checkpoint.dir to a file, hdfs, viewfs, s3a, gs or abfs folder") from e


def partitions_of(df: DataFrame, least: int = 1) -> int:
    """How many partitions Spark gives the scan below df, so that shuffled rows get as many."""
    return max(least, df.rdd.getNumPartitions())


#: Rows of a key that one task may take whatever the table's size, and the share of all rows that one may take.
HOT_ROWS, HOT_SHARE = 1_000, 10_000


def hot_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, weight: str) -> DataFrame:
    """left LEFT JOIN right on keys (equality, nulls never match); right has one row for each key.

    ``weight`` is a column of right, how many rows of left its key has about; it isn't given out. Keys of
    more than HOT_ROWS rows and more than a HOT_SHARE-th of the sum of weights are hot: less than
    HOT_SHARE keys, which are broadcast. Their rows on the left are dealt over several tasks by ``spread``, and
    their rows on the right are repeated as often; other rows aren't copied.
    """
    limit = max(HOT_ROWS, (right.agg(F.sum(weight)).first()[0] or 0) // HOT_SHARE)
    many, salt = unused([*left.columns, *right.columns], "parts", "salt")
    parts = F.when(F.col(weight) > limit, F.ceil(F.col(weight) / limit)).otherwise(1).cast("int")
    hot = right.where(F.col(weight) > limit).select(*keys, parts.alias(many))
    salted = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(many, F.lit(1))).cast("int")).drop(many)
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(weight)
    return salted.join(copies, [*keys, salt], "left").drop(salt)
