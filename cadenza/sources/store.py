"""Models and segmentation results kept in a folder: versions that appear whole or not at all."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "name string, kind string, shape array<long>, data binary"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions below path, ascending."""
    fs, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())


def save_model(spark: SparkSession, path: str, parameters: dict) -> int:
    """Saves numpy arrays and what JSON can say under a new version, and returns that.

    The version is written aside and then renamed, so readers see it whole; where another writer has taken the number, the next one is tried.
    """
    rows = []
    for name, value in parameters.items():
        if isinstance(value, np.ndarray):
            if value.dtype.hasobject:
                raise TypeError(f"{name}: arrays of objects aren't kept")
            rows.append((name, value.dtype.str, list(value.shape), bytearray(np.ascontiguousarray(value).tobytes())))
        else:
            rows.append((name, "json", None, bytearray(json.dumps(value).encode())))
    aside = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(aside)
    fs, folder = _folder(spark, aside)
    number = max(versions(spark, path), default=0) + 1
    while True:
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={number}")
        if not fs.exists(to) and fs.rename(folder, to):
            return number
        number += 1


def load_model(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The parameters of a version, by default the latest; a LookupError where there's none."""
    there = versions(spark, path)
    if not there or version not in (None, *there):
        raise LookupError(f"no version {version or ''} of a model in {path}")
    out = {}
    for row in spark.read.schema(PARTS).parquet(f"{path.rstrip('/')}/version={version or there[-1]}").collect():
        data = bytes(row.data)
        out[row.name] = json.loads(data) if row.kind == "json" else np.frombuffer(data, np.dtype(row.kind)).reshape(row["shape"]).copy()
    return out


RESULTS = "file string, i long, p array<double>, y_sp int, y_mu int, hmm int"


def write_segmentation(rows: DataFrame, path: str) -> None:
    """Appends segmentation results: scores, both truths and the sequence model's labels by file and frame."""
    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in RESULTS.split(", ")]
    rows.select(*columns).write.mode("append").parquet(path)


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(path)
