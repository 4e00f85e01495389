"""WARC archives as a PySpark Python data source.

Writing: each task writes its own gzip files (a member a record) under
temporary names of the job; the commit renames those of the tasks that ended
and deletes the job's others, as an abort deletes all, so a lost or repeated
task leaves nothing behind. Each member tells its own length in an extra
gzip field.

Reading: the files are planned into partitions by size. Predicates on the
record type and on header columns are pushed down: a record's headers are
inflated and parsed first, and the payload of an unwanted record is never
inflated; nor is any payload if the read schema has no column made from it.
Records of all types but revisits have a payload: for HTTP messages what
follows their head, else the whole block. Where a record lacks the length
header of this writer, its payload is counted, and Spark tests the count.
From the first member without the length field on, a file is read as one
inflated stream, so members may hold any number of records; plain files are
read alike. Unwanted blocks are passed over in pieces there. A record without
a content length, and a file that ends inside a record, are errors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from spendlens.llm.common import BROADCAST_ROWS, saved

#: A file is closed beyond this size; files are read together up to PARTITION bytes.
FILE, PARTITION = 256 << 20, 64 << 20
LEVEL = 1
#: Column, and the header that it is read from and written to (fixed names of the format; the last two are extensions).
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-ID",
    "payload_bytes": "X-Payload-Bytes",
}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, page_id long, payload_bytes long, payload binary"
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def digest_matches(text: str, payload: bytes) -> bool:
    """``text``: a digest in base 32 or hexadecimal, after its algorithm and a colon, or SHA-1."""
    label, _, value = text.rpartition(":")
    found = hashlib.new(label or "sha1", payload).digest()
    return value.upper() in (base64.b32encode(found).decode(), base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    kind, http = headers.get("warc-type"), headers.get("content-type", "").lower().startswith("application/http")
    if not (block.startswith(b"HTTP/") if kind == "response" else http and kind == "request"):
        return block
    end = _head_end(block)
    return block[end:] if end >= 0 else b""


def record(row: dict, payload: bytes) -> tuple[bytes, bytes]:
    """Head and block of a record; control characters of header values are escaped."""
    response = row["record_type"] == "response"
    block = _HTTP + payload if response else _HTTP
    lines = ["WARC/1.1", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response"]
    for column, name in HEADERS.items():
        if row.get(column) is not None:
            value = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in str(row[column]))
            lines.append(f"{name}: {value}")
    if not response:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block + b"\r\n\r\n"


def member(head: bytes, block: bytes) -> bytes:
    """A gzip member of head and block, flushed between them, with its length in an extra field ``SL``."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(block) + z.flush()
    both = zlib.crc32(block, zlib.crc32(head))
    size = 20 + len(body) + 8
    start = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size)
    return start + body + struct.pack("<II", both, (len(head) + len(block)) & 0xFFFFFFFF)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _temporary(self, base: str, name: str) -> str:
        return f"{base}/.{self.job}-{name}.tmp"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(base, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                data = member(*record(row, row.pop("payload") or b""))
                if out is None or size + len(data) > FILE:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(self._temporary(base, names[-1])), 0
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else []:
                where.move(self._temporary(base, name), f"{base}/{name}")
        self._clean(where, base)

    def abort(self, messages) -> None:
        self._clean(*fs.FileSystem.from_uri(self.path))

    def _clean(self, where: fs.FileSystem, base: str) -> None:
        """Deletes what the job's other attempts have written."""
        for info in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}-"):
                where.delete_file(info.path)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _head_end(data: bytes) -> int:
    at = data.find(b"\r\n\r\n")
    return at + 4 if at >= 0 else -1


def parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _plain_records(stream, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a stream of plain bytes, which needn't be able to seek."""
    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if head:
                    raise ValueError("the file ends inside a record's head")
                return
            head += line if head or line.strip() else b""
        headers = parse_head(head)
        size, need = _length(headers), wanted(headers)
        pieces = []
        while size:
            piece = stream.read(size if need else min(size, 1 << 16))
            if not piece:
                raise ValueError(f"the file ends inside the record {headers.get('warc-record-id')}")
            size -= len(piece)
            if need:
                pieces.append(piece)
        if need is not None:
            yield headers, b"".join(pieces) if need else None


def _length(headers: dict[str, str]) -> int:
    text = headers.get("content-length", "")
    if not text.isdigit():
        raise ValueError(f"the record {headers.get('warc-record-id')} has no content length")
    return int(text)


def records(stream, compressed: bool, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records for which ``wanted(headers)`` isn't
    None; the block is None unless it is True."""
    while compressed:
        start = stream.read(20)
        if not start:
            return
        if not (start[:4] == b"\x1f\x8b\x08\x04" and start[10:16] == struct.pack("<H2sH", 8, b"SL", 4)):
            stream.seek(-len(start), 1)
            break
        data = start + stream.read(struct.unpack("<I", start[16:20])[0] - 20)
        z = zlib.decompressobj(31)
        head = z.decompress(data, 4096)
        while _head_end(head) < 0 and not z.eof:
            more = z.decompress(z.unconsumed_tail, 4096)
            if not more and not z.unconsumed_tail:
                raise ValueError("the file ends inside a record's head")
            head += more
        end = _head_end(head)
        headers = parse_head(head[:end])
        need = wanted(headers)
        if need:
            yield headers, (head[end:] + z.decompress(z.unconsumed_tail))[: _length(headers)]
        elif need is not None:
            yield headers, None
    yield from _plain_records(io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16) if compressed else stream, wanted)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], types: dict[str, pa.DataType], verify: bool):
        self.path, self.columns, self.types, self.verify = path, columns, types, verify
        self.allowed: dict[str, list] = {}

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                old = self.allowed.get(f.attribute[0])
                self.allowed[f.attribute[0]] = [v for v in map(str, values) if old is None or v in old]
                if f.attribute[0] == "payload_bytes":  # not all records tell it
                    yield f
            else:
                yield f

    def partitions(self):
        where, base = fs.FileSystem.from_uri(self.path)
        out, names, size = [], [], 0
        for info in sorted(where.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and info.base_name[:1] not in "._" and info.base_name.endswith((".warc", ".warc.gz")):
                names.append(info.path)
                size += info.size
                if size >= PARTITION:
                    out.append(_Files(names))
                    names, size = [], 0
        return [*out, _Files(names)] if names or not out else out

    def read(self, partition):
        where, _ = fs.FileSystem.from_uri(self.path)
        test = {HEADERS[c].lower(): set(v) for c, v in self.allowed.items()}
        body, length = self.verify or "payload" in self.columns, HEADERS["payload_bytes"].lower()
        counted = "payload_bytes" in self.columns

        def wanted(headers):
            if any(headers.get(h) not in v for h, v in test.items() if h != length or h in headers):
                return None
            return headers.get("warc-type") != "revisit" and (body or counted and length not in headers)

        rows: list[dict] = []
        size = 0
        for name in partition.names:
            with where.open_input_file(name) as raw:
                for headers, block in records(io.BufferedReader(raw, 1 << 20), name.endswith(".gz"), wanted):
                    rows.append(self._row(headers, block))
                    size += len(block or b"") + 256
                    if size >= 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, headers: dict[str, str], block: bytes | None) -> dict:
        row = {c: headers.get(HEADERS[c].lower()) for c in self.columns if c in HEADERS}
        if block is not None:
            payload, digest = payload_of(headers, block), headers.get("warc-payload-digest")
            if self.verify and digest is not None and not digest_matches(digest, payload):
                raise ValueError(f"the payload of {headers.get('warc-record-id')} doesn't match its digest")
            row["payload"] = payload
            if "payload_bytes" in row:
                row["payload_bytes"] = len(payload)
        for c in ("page_id", "payload_bytes"):
            if row.get(c) is not None:
                row[c] = int(row[c])
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], self.types[c]) for c in self.columns], self.columns)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options ``path`` and ``verify`` (true:
    payload digests are checked). A narrower read schema reads less."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        columns = schema.fieldNames()
        return _Reader(self.options["path"], columns, {c: types.get(c, pa.string()) for c in columns}, self.options.get("verify", "false") == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def uri(path: str) -> str:
    """With a scheme, as pyarrow asks for."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def to_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record row per page. Of pages with equal payloads of at least
    ``least_bytes``, the one with the smallest page_id is the response, the
    others revisit it and carry no payload; smaller ones are all responses.

    Null html: the empty payload. Rows that repeat the smallest page_id are
    responses all. A null page_id comes after all others; among nulls only,
    all are responses. Other columns are ignored; an empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    ids = own.where(F.col("payload_bytes") >= least_bytes).select("sha1", "page_id")
    again = saved(ids.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("sha1", "first"))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    found = own.join(again, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= least_bytes)
    return found.withColumn("revisit", revisit).select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        "target_uri", "sha1",
        F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        "page_id", "payload_bytes", F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex):
    """Base32 of a hexadecimal SHA-1: 160 bits, five a letter."""
    letters = F.lit(BASE32)
    parts = []
    for i in range(0, 40, 10):  # 40 bits, eight letters
        n = F.conv(F.substring(sha1_hex, i + 1, 10), 16, 10).cast("long")
        parts += [F.substring(letters, (F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*parts)


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    rows = to_records(pages, least_bytes).withColumn("payload_digest", base32(F.col("sha1"))).drop("sha1")
    rows.select(*HEADERS, "payload").write.format("warc").mode("append").option("path", uri(path)).save()


def read(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).option("path", uri(path)).option("verify", str(verify).lower()).load()
