"""Waves, matrices and annotations from files; results to files."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.functions.arrays import stem


def decoded(data: bytes, to: int = 0) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1] of PCM WAV bytes, at the rate ``to`` if given."""
    with wave.open(io.BytesIO(data)) as w:
        fs, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(1)
    return (to, kernels.resampled(x, fs, to)) if to and to != fs else (fs, x)


def read_waves(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(file, cls, fs, samples) of all .wav files below path; the class is the folder's name. rate 0 keeps each file's own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [decoded(data, rate) for data in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "fs": [fs for fs, _ in found], "samples": [x for _, x in found]})

    waves = files.select("path", "content").mapInPandas(run, "path string, fs int, samples array<double>")
    return waves.select(stem("path").alias("file"), F.element_at(F.split("path", "/"), -2).alias("cls"), "fs", "samples")


def read_matrices(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(file, frame, v) of .npy matrices of ``dims`` columns or rows; pickled ones are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, data in zip(pdf["path"], pdf["content"]):
                m = np.load(io.BytesIO(data), allow_pickle=False)
                m = m if m.shape[1] == dims else m.T
                yield pd.DataFrame({"path": p, "frame": np.arange(len(m)), "v": list(m.astype(float))})

    rows = files.select("path", "content").mapInPandas(run, "path string, frame long, v array<double>")
    return rows.select(stem("path").alias("file"), "frame", "v")


def missing(files: DataFrame, store: DataFrame) -> DataFrame:
    """The files that a feature store doesn't hold yet."""
    return files.join(store.select("file").distinct(), "file", "left_anti")


def memoised(inputs: DataFrame, path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute(inputs) for the rows whose keys the Parquet store at path lacks, appended to it; the store's rows for all inputs' keys.

    Keys that are null are computed each time, as they meet nothing.
    """
    spark = inputs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    new = inputs.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if there else inputs
    compute(new).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(inputs.select(*keys).distinct(), keys, "left_semi")


def write_features(rows: DataFrame, path: str) -> None:
    """Appends (feat, cls, file, frame, v) to a Parquet store by feat and cls."""
    rows.write.mode("append").partitionBy("feat", "cls").parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, t0, dur, cls) of CSV files without a header, quoted by |; blank lines go."""
    rows = spark.read.schema("t0 double, dur double, cls string").option("quote", "|").csv(path)
    return rows.where("t0 is not null").select(stem(F.input_file_name()).alias("file"), "*")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, duration, xmin, xmax) of the intervals in TextGrid files."""
    whole = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("file"), "value")
    pattern = r'xmin = ([0-9.]+)\s+xmax = ([0-9.]+)\s+text = "([^"]*)"'
    found = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(pattern), F.lit(k)).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))))
    rows = whole.select("file", F.explode(found).alias("m"))
    a, b = F.col("m.a").cast("double"), F.col("m.b").cast("double")
    return rows.select("file", F.col("m.c").alias("label"), (b - a).alias("duration"), a.alias("xmin"), b.alias("xmax"))


def write_results(rows: DataFrame, path: str) -> None:
    """Appends rows as tab-separated files with a header."""
    rows.write.mode("append").csv(path, sep="\t", header=True)


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    """(key, value) of a configuration as JSON; what JSON can't say is ERROR."""
    import json

    def text(v) -> str:
        try:
            return json.dumps(v)
        except TypeError:
            return "ERROR"

    return spark.createDataFrame([(k, text(v)) for k, v in config.items()], "key string, value string")
