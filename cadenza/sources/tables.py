"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, or below setCheckpointDir's; a local master without either gets a local folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.startswith("local"):
            root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a shared folder, read again: its lineage ends there, and its rows and their order in files are fixed."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
