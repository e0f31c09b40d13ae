"""WARC archives as a Python data source, with payload deduplication by revisit records.

Archives are .warc.gz files of one gzip member a record. Each member tells its compressed and its full
length in an extra field, so a reader inflates a record's headers, a few kB at a time, parses them, and goes on
to the next member when type or headers aren't wanted, or when only the payload's length is.
The fixed bytes at a member's begin let a large file be split by byte ranges. Files without that
field, and plain .warc files, are read whole by one task each.

Options: path; payload (true: give the payload, else null); verify (true: check digests of response
payloads); split_bytes. Filters that are pushed down: equality, IN, prefixes and presence, on the header columns.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from . import common

#: gzip header: deflate, extra field, no time, of unknown system, 12 bytes of extra: 'sl', 8 bytes.
MAGIC = bytes([0x1F, 0x8B, 8, 4, 0, 0, 0, 0, 0, 255, 12, 0]) + b"sl" + bytes([8, 0])
SPLIT_BYTES = 128 << 20
#: Headers are looked for in this much of a record first.
PEEK = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Tells that the target URI is percent-encoded beyond the rules, as it has line breaks or outer white space.
QUOTED = "X-Target-URI-Quoted"
URI_SIGNS = ":/?#[]@!$&'()*+,;="
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
ROWS = 500


def member(data: bytes, level: int = 6) -> bytes:
    """data as a gzip member that tells its lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return MAGIC + struct.pack("<II", len(MAGIC) + 8 + len(body) + 8, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, payload: bytes, digest: str, n: int, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit record with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None and (uri.strip() != uri or "\r" in uri or "\n" in uri):  # what a header line can't hold
        lines += [f"WARC-Target-URI: {quote(uri, safe=URI_SIGNS)}", f"{QUOTED}: yes"]
    elif uri is not None:
        lines.append(f"WARC-Target-URI: {uri}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    """Header fields of a record's begin; names in lower case."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    end: int | None  # None: one task reads the file whole


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.names, int(self.options.get("level", "6")), overwrite)


def _manifests(fs, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith("_manifest-") and x.base_name.endswith(".json"))


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file under a new name; the commit lists the files of the successful tasks.

    Every commit writes a manifest of its own, by renaming, and readers take the files of all of them, so
    appends, one after another or side by side, keep each other's records. An overwrite takes away the older ones
    once its own is there.
    """

    def __init__(self, path: str, names: list[str], level: int, overwrite: bool = False):
        self.path, self.names, self.level, self.overwrite = path, names, level, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = common.filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in iterator:
            at = {c: batch.column(self.names.index(c)).to_pylist() for c in self.names}
            for i in range(batch.num_rows):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                r = {c: at[c][i] for c in self.names}
                data = record(r["record_id"], r["record_type"], r["target_uri"], r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"])
                out.write(member(data, self.level))
                n += 1
        if out:
            out.close()
        return Written(name if out else "", n)

    def commit(self, messages: list[Written]) -> None:
        fs, root = common.filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"path": m.path, "records": m.records} for m in messages if m and m.path]
        old = _manifests(fs, root) if self.overwrite else []
        name = f"{root}/_manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(files).encode())
        fs.move(f"{name}.tmp", f"{name}.json")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = common.filesystem(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(f"{root}/{m.path}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.equal: dict[str, list[str]] = {}
        self.begins: list[tuple[str, str]] = []
        self.present: list[str] = []
        #: Bytes that the records of this package's own files were inflated to.
        self.inflated = 0

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS and name not in self.equal:
                self.equal[name] = [f.value]
            elif isinstance(f, In) and name in HEADERS and name not in self.equal:
                self.equal[name] = list(f.value)
            elif isinstance(f, StringStartsWith) and name in HEADERS:
                self.begins.append((name, f.value))
            elif isinstance(f, IsNotNull) and name in HEADERS:
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = common.filesystem(self.options["path"])
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        listed = fs.get_file_info([root])[0]
        if listed.type == pafs.FileType.File:
            files = [listed]
        elif manifests := _manifests(fs, root):
            files = []
            for path in manifests:
                with fs.open_input_stream(path) as f:
                    files += fs.get_file_info([f"{root}/{x['path']}" for x in json.loads(f.read())])
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            files = sorted((x for x in found if x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
        out = []
        for x in files:
            with fs.open_input_file(x.path) as f:
                own = f.read(len(MAGIC)) == MAGIC
            out += [Piece(x.path, at, min(at + split, x.size)) for at in range(0, x.size, split)] if own else [Piece(x.path, 0, None)]
        return out or [Piece("", 0, 0)]

    def wanted(self, row: dict) -> bool:
        return all(row[k] in v for k, v in self.equal.items()) and all((row[k] or "").startswith(v) for k, v in self.begins) and all(row[k] is not None for k in self.present)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        fs, _ = common.filesystem(self.options["path"])
        rows: list[dict] = []
        with fs.open_input_file(piece.path) as f:
            for row in self._members(f, piece) if piece.end is not None else self._whole(f, piece.path):
                rows.append(row)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _members(self, f, piece: Piece) -> Iterator[dict]:
        at = piece.begin and _next_member(f, piece.begin, piece.end)
        size = len(MAGIC) + 8
        while at is not None and at < piece.end:
            f.seek(at)
            head = f.read(size + PEEK)
            length, _full = struct.unpack_from("<II", head, len(MAGIC))
            part = _Member(f, head[size:length], max(0, length - len(head)))
            if row := self._row(part.until(0)):
                yield self._full(row, part)
            self.inflated += part.inflated
            at += length

    def _whole(self, f, path: str) -> Iterator[dict]:
        """Records of any .warc or .warc.gz file, one after another."""
        stream = io.BufferedReader(_Inflated(f) if path.endswith(".gz") else f)
        while True:
            head = bytearray()
            while not head.endswith(b"\r\n\r\n"):
                if not (line := stream.readline()):
                    return
                if head or line.strip():
                    head += line
            size = int(parsed(bytes(head)).get("content-length", "0"))
            if row := self._row(bytes(head)):
                yield self._full(row, _Held(bytes(head) + stream.read(size)))
            elif path.endswith(".gz"):
                while size and (skipped := stream.read(min(size, 1 << 20))):
                    size -= len(skipped)
            else:
                stream.seek(size, 1)

    def _row(self, text: bytes) -> dict | None:
        fields = parsed(text.partition(b"\r\n\r\n")[0])
        strip = lambda s: s[1:-1] if s and s[0] == "<" and s[-1] == ">" else s
        row = {k: strip(fields.get(h.lower())) for k, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if row["target_uri"] and QUOTED.lower() in fields:
            row["target_uri"] = unquote(row["target_uri"])
        row["__length"] = int(fields.get("content-length", "0"))
        return row if self.wanted(row) else None

    def _full(self, row: dict, part: _Held) -> dict:
        """The row with its payload, or with the payload's length alone: then no more than the HTTP headers are inflated."""
        length, own = row.pop("__length"), row["record_type"] == "response"
        verify, give = self.options.get("verify", "false") == "true", self.options.get("payload", "true") == "true"
        row["payload"] = None
        if not own or not (verify or give):
            block = part.until(1).partition(b"\r\n\r\n")[2]
            http, end, _ = block.partition(b"\r\n\r\n")
            row["payload_bytes"] = max(0, length - len(http) - len(end)) if own else int(parsed(http).get("content-length", "0"))
            return row
        payload = part.all().partition(b"\r\n\r\n")[2][:length].partition(b"\r\n\r\n")[2]
        row["payload_bytes"] = len(payload)
        if verify and hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
            raise ValueError(f"payload of {row['record_id']} doesn't meet its digest")
        row["payload"] = payload if give else None
        return row


class _Held:
    """A record that's in memory."""

    def __init__(self, text: bytes):
        self.text = text

    def until(self, blank: int) -> bytes:
        return self.text

    def all(self) -> bytes:
        return self.text


class _Member(_Held):
    """A record in a gzip member, inflated no further than asked for; ``inflated`` counts bytes."""

    def __init__(self, f, data: bytes, rest: int):
        self.f, self.rest, self.data = f, rest, data
        self.inflate, self.text, self.inflated = zlib.decompressobj(-15), b"", 0

    def _more(self, most: int) -> bool:
        """Inflates up to ``most`` more bytes; false at the end."""
        if not self.data and self.rest:
            self.data = self.f.read(min(self.rest, PEEK if most else self.rest))
            self.rest -= len(self.data)
        out = self.inflate.decompress(self.data, most)
        ended = not out and not self.rest and not self.inflate.unconsumed_tail
        self.data = self.inflate.unconsumed_tail
        self.text += out
        self.inflated += len(out)
        return not (ended or self.inflate.eof)

    def until(self, blank: int) -> bytes:
        """The begin of the record, with the blank line of that number in it, if there is one."""
        while self.text.count(b"\r\n\r\n") <= blank and self._more(PEEK):
            pass
        return self.text

    def all(self) -> bytes:
        while self._more(0):
            pass
        return self.text


class _Inflated(io.RawIOBase):
    """The bytes of all members of a gzip file."""

    def __init__(self, f):
        self.f, self.inflate, self.held = f, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.inflate.eof:
                self.held, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.held or self.f.read(1 << 16)
            if not data:
                return 0
            out = self.inflate.decompress(data, len(buffer))
            self.held = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)


def _next_member(f, begin: int, end: int) -> int | None:
    """Where the first member that begins in [begin, end) begins."""
    at, tail = begin, b""
    f.seek(begin)
    while at < end + len(MAGIC) and (data := f.read(1 << 20)):
        found = (tail + data).find(MAGIC)
        if found >= 0:
            place = at - len(tail) + found
            return place if place < end else None
        at += len(data)
        tail = data[-len(MAGIC) + 1 :]
    return None


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The WARC rows of pages (page_id, url, html): payloads in UTF-8, a null html as an empty one.

    Of pages with equal payloads (by SHA-1 and length) of at least ``least`` bytes the one with the
    largest page_id is the response and the others revisit it; rows with that page_id are responses,
    as are pages without a page_id and shorter ones. Rows that repeat a page_id with other payloads
    are records of their own: each revisits what has its own payload. An empty table gives no rows; other columns aren't looked at. Ids and
    digests, kept once, meet by payload, the hot ones dealt over several tasks; the payloads themselves move
    only if there are too many revisits for a broadcast, which Spark tells from the size of the saved table.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.cast("binary").alias("payload"))
    keyed = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(f"n >= {least} and page_id is not null")
    keyed = common.saved(keyed, "payloads")
    groups = common.saved(keyed.groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "groups")
    again = common.hot_left_join(keyed, groups, ["digest", "n"], F.col("page_id"), "copies").where("first is not null and first != page_id")
    again = common.saved(again.groupBy("page_id", "digest", "n").agg(F.first("first").alias("first")), "revisits")
    # Rows without a page_id match nothing; they are dealt over tasks by their urls.
    apart = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", F.octet_length("payload")), F.lit(1024))).otherwise(0)
    found = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload"), "salt": apart}).join(again.withColumn("salt", F.lit(0).cast("long")), ["page_id", "digest", "n", "salt"], "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return found.select(
        urn("page_id").alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("first").isNotNull(), urn("first")).alias("refers_to"),
        F.col("n").cast("long").alias("payload_bytes"),
        "payload",
    )


def write(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """SCHEMA of the archives below path; filters on record_type and the other headers are pushed down."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back with its digest checked."""
    path = common.shared_dir(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    rows = read(spark, path, payload="false", verify="true").where("record_type in ('response', 'revisit')")
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": """with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest, b from p),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by b) end as first from d)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to from m"""
}
