"""SentencePiece encoding with spans of the source, and decoding.

Texts are normalised by the model's compiled character map with longest-prefix matching
(charsmap.py), which records where each byte came from; pieces are projected through that record
to byte spans of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .charsmap import CharsMap, normalise
from .encoders import PieceEncoder

#: Columns that ``encode`` can give besides doc_id.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "begins": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "span_bytes": ("bigint", pa.int64()),
    "spans_sha256": ("string", pa.string()),
}


class Codec:
    """Encodes texts as the library does, with the source's byte span of every piece."""

    def __init__(self, path: str):
        self.encoder = e = PieceEncoder(path)
        self.table = CharsMap(e.spec.charsmap)
        names = map(e.model.id_to_piece, range(e.size))
        #: Bytes of each piece in a normalised text; a byte piece has one, an unknown one is as long as what it stands for.
        self.length = np.array([1 if e.model.is_byte(i) else 0 if e.model.is_unknown(i) else len(name.encode()) for i, name in enumerate(names)], np.int64)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of all pieces in the source's bytes, projected through the recorded alignment."""
        out, aligned = normalise(text, self.encoder.spec, self.table)
        size = self.length[ids] if ids else np.zeros(0, np.int64)
        if size.sum() != len(out):  # unknown pieces
            size = np.array([len(s) for s in _surfaces(self.encoder.model.encode(text, return_type="proto").pieces)], np.int64)
        ends = np.cumsum(size)
        return aligned[ends - size], aligned[ends]

    def rows(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """(ids, spans' begins and ends, decoded text) of each text."""
        model = self.encoder.model
        for text, ids in zip(texts, model.encode(texts, num_threads=1)):
            yield ids, *self.spans(text, ids), model.decode(ids)


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    """The codec of a worker, kept for its next task."""
    return Codec(path)


def _surfaces(pieces) -> list[bytes]:
    """Normalised bytes of the pieces; of bytes that fell back, each piece has one byte of the character."""
    out = []
    for p in pieces:
        name = p.piece
        out.append(b"\0" if len(name) == 6 and name.startswith("<0x") and name.endswith(">") else name.encode())
    return out


def encode(docs: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """doc_id and the asked-for columns of OUTPUTS, a row for each row of docs (doc_id, text).

    begins and ends are byte spans in the source of each id's piece, end exclusive; spans_sha256 is the SHA-256
    of all begins, then all ends, as little-endian 64-bit integers. A null text counts as an empty one, which has
    no ids and decodes to an empty text. doc_id may be null or repeated; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        names = codec.encoder.texts
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out: dict[str, list] = {c: [] for c in columns}
            for ids, begins, ends, decoded in codec.rows(texts):
                for c in columns:
                    if c == "ids":
                        v = ids
                    elif c == "begins":
                        v = begins.tolist()
                    elif c == "ends":
                        v = ends.tolist()
                    elif c == "decoded":
                        v = decoded
                    elif c == "n_tokens":
                        v = len(ids)
                    elif c == "ids_sha256":
                        v = hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest()
                    elif c == "decoded_sha256":
                        v = hashlib.sha256(decoded.encode()).hexdigest()
                    elif c == "spans_sha256":
                        v = hashlib.sha256(np.concatenate([begins, ends]).astype("<i8").tobytes()).hexdigest()
                    else:
                        v = int(ends[-1]) if len(ends) else 0
                    out[c].append(v)
            arrays = [pa.array(out[c], OUTPUTS[c][1]) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *columns])

    schema = ", ".join(["doc_id bigint", *(f"{c} {OUTPUTS[c][0]}" for c in columns)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.by_text(run, 1), schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the decoded text of rows with doc_id and ids array<int>; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceEncoder(model).model
        for batch in batches:
            texts = [codec.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(common.tidy(run), "doc_id bigint, decoded string")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, of the decoded text and of all pieces' source spans for every text of documents."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])


QUERIES = {"op2_piece_codec": op2_piece_codec}
ORACLES: dict[str, str] = {}
