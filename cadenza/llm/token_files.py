"""Token-ID files: Arrow IPC files of fixed-size-list batches, with an index of the documents.

A data file holds rows of ``length`` ids each and, beside them, a mask of one bit an id (bit set:
a token; clear: padding of the file's last row). Documents lie end to end in ascending doc_id
order. A second Arrow file has (doc_id, first, n_tokens) of the file's documents, ``first`` counted
in ids from the file's begin. A manifest names the files in order. Readers map a file and get
rows, masks and documents as views of the mapped bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .encoders import load
from .runs import RunTable

LENGTH = 2048
BATCH_ROWS = 512
MANIFEST = "part int, path string, docs_path string, n_docs long, n_ids long"


def _schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(dtype, length)), pa.field("mask", pa.list_(pa.uint8(), length // 8))])


class _Writer:
    """Rows of ids to one data file; keeps less than a batch in memory."""

    def __init__(self, fs, path: str, dtype: np.dtype, length: int):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = _schema(pa.from_numpy_dtype(self.dtype), length)
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.parts: list[bytes] = []
        self.held = self.total = 0
        self.full = BATCH_ROWS * length * self.dtype.itemsize

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids) // self.dtype.itemsize
        if self.held >= self.full:
            data = b"".join(self.parts)
            whole = len(data) // self.full * self.full
            self._write(data[:whole], whole // self.dtype.itemsize)
            self.parts, self.held = [data[whole:]], len(data) - whole

    def _write(self, data: bytes, n: int) -> None:
        ids = np.frombuffer(data, self.dtype)
        rows = -(-len(ids) // self.length)
        ids = np.concatenate([ids, np.zeros(rows * self.length - len(ids), self.dtype)])
        mask = np.packbits(np.arange(rows * self.length) < n, bitorder="little")
        for at in range(0, rows, BATCH_ROWS):
            to = min(at + BATCH_ROWS, rows)
            one = pa.FixedSizeListArray.from_arrays(pa.array(ids[at * self.length : to * self.length]), self.length)
            two = pa.FixedSizeListArray.from_arrays(pa.array(mask[at * self.length // 8 : to * self.length // 8]), self.length // 8)
            self.file.write_batch(pa.RecordBatch.from_arrays([one, two], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(b"".join(self.parts), self.held // self.dtype.itemsize)
        self.file.close()
        self.out.close()


def encoded(texts: pa.Array, encoder, table: RunTable, dtype: np.dtype) -> Iterator[bytes]:
    """The ids of each text as bytes."""
    if encoder.by_runs:
        for ids in table.ids(texts):
            yield ids.tobytes()
    else:
        for text in texts.to_pylist():
            yield encoder.whole([text or ""])[0].astype(dtype).tobytes()


@lru_cache(maxsize=2)
def _tools(tokenizer: str) -> tuple:
    """Encoder, ids' type and table of runs of a worker, kept for its next task."""
    encoder = load(tokenizer)
    dtype = np.dtype("<u2" if encoder.size <= 65536 else "<u4")
    return encoder, dtype, RunTable(encoder.runs, encoder.each, dtype)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = LENGTH, partitions: int | None = None) -> list:
    """Encodes docs (doc_id long, text string) into token files below folder; returns the manifest's rows.

    doc_ids ascend over the files and in them; rows with equal doc_ids follow each other by text, null
    ids come first. A null text counts as an empty one: it yields the end id alone. An empty table
    gives no files. ``length`` must be a multiple of 8. Files get new names at each try of a task, and
    only those of successful tries are in the manifest, which is written last, by renaming.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    common.filesystem(folder)  # raises here, not in a task, if there's no such store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = None
        encoder, dtype, runs = _tools(tokenizer)
        end = np.array([end_id], dtype).tobytes()
        fs, root = common.filesystem(folder)
        part = TaskContext.get().partitionId()
        ids: list[pa.Array] = []
        first: list[int] = []
        count: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}"
                writer = _Writer(fs, f"{root}/{name}.arrow", dtype, length)
            ids.append(batch.column(0))
            for data in encoded(batch.column(1), encoder, runs, dtype):
                first.append(writer.total)
                writer.add(data + end)
                count.append(writer.total - first[-1])
        if writer is None:
            return
        writer.close()
        table = pa.table({"doc_id": pa.chunked_array(ids), "first": pa.array(first, pa.int64()), "n_tokens": pa.array(count, pa.int64())})
        with fs.open_output_stream(f"{root}/{name}.docs.arrow") as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{name}.arrow", "docs_path": f"{name}.docs.arrow", "n_docs": len(first), "n_ids": writer.total}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs_path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    n = partitions or common.partitions_of(docs)
    # Ranges are of doc_id and the text's begin, so that rows of one doc_id may lie in many tasks; the order is the same.
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows = sorted(ordered.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.part)  # one row for each file
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.tmp") as out:
        out.write(json.dumps({"length": length, "files": [r.asDict() for r in rows]}).encode())
    fs.move(f"{root}/manifest.tmp", f"{root}/manifest.json")
    return rows


class TokenFile:
    """Random access to one data file. Local files are mapped: rows, masks and documents are views."""

    def __init__(self, folder: str, path: str, docs_path: str):
        fs, root = common.filesystem(folder)
        local = fs.type_name == "local"
        opened = (lambda p: pa.memory_map(f"{root}/{p}")) if local else (lambda p: fs.open_input_file(f"{root}/{p}"))
        self.reader = pa.ipc.open_file(opened(path))
        self.docs = pa.ipc.open_file(opened(docs_path)).read_all()
        self.length = self.reader.schema.field("ids").type.list_size
        self.last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (rows x length) and packed masks (rows x length / 8) of batch k, without a copy."""
        if self.last[0] != k:  # documents lie one after another, and far stores give whole batches
            self.last = k, self.reader.get_batch(k)
        b = self.last[1]
        ids, mask = (b.column(i).flatten().to_numpy(zero_copy_only=True) for i in (0, 1))
        return ids.reshape(-1, self.length), mask.reshape(-1, self.length // 8)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i and its mask as booleans."""
        ids, mask = self.batch(i // BATCH_ROWS)
        return ids[i % BATCH_ROWS], np.unpackbits(mask[i % BATCH_ROWS], bitorder="little").view(bool)

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from place first on: a view unless they lie in several batches."""
        size, out = BATCH_ROWS * self.length, []
        while n:
            flat = self.batch(first // size)[0].reshape(-1)[first % size :][:n]
            out.append(flat)
            first, n = first + len(flat), n - len(flat)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def documents_of(spark: SparkSession, folder: str, rows: list) -> DataFrame:
    """Reads token files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    bases = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    listed = spark.createDataFrame([(r.path, r.docs_path, b) for r, b in zip(rows, bases)], "path string, docs_path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                file = TokenFile(folder, one["path"], one["docs_path"])
                for docs in file.docs.to_batches(max_chunksize=10_000):
                    first, count = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(file.ids(a, n).astype("<u4")) for a, n in zip(first.tolist(), count.tolist())]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(first + one["base"]), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = listed.repartition(max(1, len(rows))) if rows else listed
    return spread.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as token files, read back (see documents_of)."""
    import public_tokenizers

    folder = common.shared_dir(spark, "token-files")
    rows = write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return documents_of(spark, folder, rows)


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
