"""A sharded table: small immutable shards, size-tiered compaction, versioned manifests.

An append writes its rows as shards under new names and commits a manifest that names the old shards
and the new ones. Compaction merges runs of similarly sized shards (of one tier: sizes within a factor
of FANOUT) into shards of up to ``target`` bytes, one task each, streaming row groups; then it commits a manifest
with the merged shards in place of their sources. A manifest is committed by renaming it to its version's
name, which fails if that is taken: a writer that comes second reads the new version and tries again.
Readers see one version's shards whole. ``vacuum`` deletes shards that no manifest from a version on names.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TARGET = 64 << 20
FANOUT = 4
#: Rows of a new shard at the most.
SHARD_ROWS = 20_000


def _version_path(folder: str, version: int) -> str:
    return f"{folder}/manifest-{version:08d}.json"


def latest(folder: str) -> tuple[int, list[dict]]:
    """The newest version and its shards ({path, bytes, rows}, in order); (0, []) if there's none."""
    fs, root = common.filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = sorted(x.base_name for x in found if x.base_name.startswith("manifest-") and x.base_name.endswith(".json"))
    if not names:
        return 0, []
    with fs.open_input_stream(f"{root}/{names[-1]}") as f:
        return int(names[-1][9:-5]), json.loads(f.read())["shards"]


def commit(spark: SparkSession, folder: str, change: Callable[[list[dict]], list[dict] | None]) -> int:
    """Commits change(shards of the newest version) as the next one; null changes nothing. Returns the version."""
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(folder), spark._jsc.hadoopConfiguration())
    path = jvm.org.apache.hadoop.fs.Path
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        version, shards = latest(folder)
        new = change(shards)
        if new is None:
            return version
        name = f"manifest-{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(json.dumps({"version": version + 1, "shards": new}).encode())
        try:
            files.rename(path(f"{folder}/{name}"), path(_version_path(folder, version + 1)), none)
            return version + 1
        except Exception as e:
            fs.delete_file(f"{root}/{name}")
            if "FileAlreadyExists" not in str(e):
                raise


def append(df: DataFrame, folder: str, rows: int = SHARD_ROWS) -> int:
    """Adds df's rows as shards of at most ``rows`` rows. An empty df commits nothing new. Returns the version.

    Rows are kept as they are: nulls, repeated rows and any columns. Arrivals may have different columns; a
    merged shard has the columns of all its sources, with nulls where a source lacks one, in the wider type
    where types differ (types that have none in common are an error). Readers choose columns by their schema.
    """
    spark = df.sparkSession
    arrival = f"data/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{folder}/{arrival}")
    fs, root = common.filesystem(folder)
    # The executors read the footers: a row for each new shard.
    back = spark.read.schema(df.schema).parquet(f"{folder}/{arrival}").groupBy(F.col("_metadata.file_name").alias("name")).count()
    counts = {r[0]: r[1] for r in back.collect()}
    found = sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{arrival}")), key=lambda x: x.base_name)
    new = [{"path": f"{arrival}/{x.base_name}", "bytes": x.size, "rows": counts[x.base_name]} for x in found if counts.get(x.base_name)]
    return commit(spark, folder, lambda shards: shards + new if new else None)


def tier(size: int, least: int = 1 << 16, fanout: int = FANOUT) -> int:
    return max(0, int(math.log(max(size, 1) / least, fanout))) if size > least else 0


def runs(shards: list[dict], target: int = TARGET, fanout: int = FANOUT) -> list[list[dict]]:
    """What to merge: in each tier of at least ``fanout`` shards smaller than half the target, runs of up to target bytes."""
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if 2 * s["bytes"] < target:
            tiers.setdefault(tier(s["bytes"], fanout=fanout), []).append(s)
    out = []
    for _, own in sorted(tiers.items()):
        if len(own) < fanout:
            continue
        run, size = [], 0
        for s in own:
            if run and size + s["bytes"] > target:
                out.append(run)
                run, size = [], 0
            run.append(s)
            size += s["bytes"]
        out.append(run)
    return [run for run in out if len(run) > 1]


def _fitted(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """batch with the columns and types of schema; nulls where it lacks a column."""
    names = batch.schema.names
    columns = [batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def merge(spark: SparkSession, folder: str, found: list[list[dict]]) -> int:
    """Writes a shard for each run and commits it in place of the run's shards, where these are all still there."""
    paths = spark.sparkContext.broadcast([[s["path"] for s in run] for run in found])  # names that the manifest has as well

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, n = f"data/merged-{uuid.uuid4().hex}.parquet", 0
                schemas = []
                for p in paths.value[k]:
                    with fs.open_input_file(f"{root}/{p}") as f:
                        schemas.append(pq.read_schema(f).remove_metadata())
                schema = pa.unify_schemas(schemas, promote_options="permissive")
                with pq.ParquetWriter(f"{root}/{name}", schema, filesystem=fs, compression="zstd") as writer:
                    for p in paths.value[k]:
                        with fs.open_input_file(f"{root}/{p}") as f:
                            for part in pq.ParquetFile(f).iter_batches(batch_size=2_000):
                                writer.write_batch(_fitted(part, schema), row_group_size=20_000)
                                n += part.num_rows
                size = fs.get_file_info([f"{root}/{name}"])[0].size
                yield pa.RecordBatch.from_pylist([{"run": k, "path": name, "bytes": size, "rows": n}], schema=pa.schema([("run", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64())]))

    each = spark.range(0, len(found), 1, len(found))  # one merge in each task
    done = each.mapInArrow(write, "run int, path string, bytes long, rows long").collect()  # one row for each merged shard

    def change(shards: list[dict]) -> list[dict] | None:
        here = {s["path"] for s in shards}
        new, gone = [], set()
        for r in done:
            old = {s["path"] for s in found[r.run]}
            if old <= here:
                gone |= old
                new.append({"path": r.path, "bytes": r.bytes, "rows": r.rows})
        return [s for s in shards if s["path"] not in gone] + new if new else None

    return commit(spark, folder, change)


def compact(spark: SparkSession, folder: str, target: int = TARGET, fanout: int = FANOUT) -> int:
    """Merges until no tier has ``fanout`` shards that a merge makes fewer. Returns the version."""
    version, shards = latest(folder)
    while found := runs(shards, target, fanout):
        version = merge(spark, folder, found)
        last, (_, shards) = len(shards), latest(folder)
        if len(shards) >= last:
            break
    return version


def vacuum(folder: str, keep_from: int) -> int:
    """Deletes manifests older than version keep_from and shards that no later one names; returns how many shards went.

    Not to be run beside an append or a merge: shards that are written but not committed would go.
    """
    fs, root = common.filesystem(folder)
    named: set[str] = set()
    for x in fs.get_file_info(pafs.FileSelector(root)):
        if x.base_name.startswith("manifest-") and x.base_name.endswith(".json"):
            if int(x.base_name[9:-5]) < keep_from:
                fs.delete_file(x.path)
            else:
                with fs.open_input_stream(x.path) as f:
                    named |= {s["path"] for s in json.loads(f.read())["shards"]}
    gone = 0
    for x in fs.get_file_info(pafs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)):
        if x.is_file and x.base_name.endswith(".parquet") and x.path[len(root) + 1 :] not in named:
            fs.delete_file(x.path)
            gone += 1
    return gone


def read(spark: SparkSession, folder: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default; no rows if there is none."""
    if version is None:
        _, shards = latest(folder)
    else:
        fs, root = common.filesystem(folder)
        with fs.open_input_stream(_version_path(root, version)) as f:
            shards = json.loads(f.read())["shards"]
    if not shards:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/{s['path']}" for s in shards))


def op4_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in four arrivals, compacted and read back: doc_id, lang, source, n_chars and the text's SHA-256."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_dir(spark, "shards")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    for k in range(4):
        append(docs.where(part == k), folder)
    vacuum(folder, compact(spark, folder))
    return read(spark, folder, docs.schema).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op4_shard_compaction": op4_shard_compaction}
ORACLES = {"op4_shard_compaction": "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents"}
