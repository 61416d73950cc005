"""WARC archives as a PySpark data source, read and written by Spark tasks.

Writing: every task writes archives of about ``max_bytes`` to the given folder, WARC 1.1
with one gzip member per record: date, ``<...>`` around ids, ``sha1:`` before digests, a
profile on revisits, an HTTP head before a response's payload. A member notes its own
length in a gzip extra field, so that a reader can step over it without inflating it.
Files are made under their final, unique names and listed in a manifest at commit; files
of failed or repeated tasks are in no manifest and are never read.

Reading: the driver plans partitions from the manifests and the folder's other ``.warc``
and ``.warc.gz`` files (sizes only); large files give one partition each, small ones
share. Filters on ``record_type`` and on header columns are pushed down. A task decodes a
record's headers first, applies the filters, and decodes the payload only if the record
passes and the schema in use asks for ``payload``. What is not wanted is stepped over in
plain archives and in those of this writer; other gzip members have to be inflated to
find their end, their bytes are dropped as they come.

Paths may be any that PyArrow's file systems or Hadoop paths mounted as such know;
the folder must be shared by driver and executors.

Defined cases: null payload is empty; a null id is written as a new ``urn:uuid:``, a null
date as the time of writing, any other null header is left out and read as null; control
characters in a header are percent-encoded and nothing else is, the exact value goes into a
header of this writer beside it; repeated records stay; an empty table gives a manifest
without files. From other writers, ``payload_bytes`` of a revisit without a length is null, a
payload is what follows the HTTP head, still in its transfer or content encoding, and a
digest with a label other than ``sha1:`` keeps it. An archive that ends inside a record or
has anything else than a record where one should start is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceArrowWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from marts.llm.workers import ship

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, record_date string, payload binary"
)

#: WARC header of each column.
_HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "record_date": "WARC-Date",
}
_EXACT = "X-Exact-"
_HTTP = "application/http"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
_EXTRA = b"WL"
_HEAD = struct.Struct("<4sLBBH2sHL")
_CHUNK = 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_lines(name: str, value: str) -> list[str]:
    """A header on one line; where that changes the value, the exact one on a second line."""
    line = re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", value)
    exact = [] if line == value == value.strip() else [f"{_EXACT}{name}: {quote(value, safe='')}"]
    return [f"{name}: {line}", *exact]


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member that carries its own length."""
    lines = ["WARC/1.1"]
    for k, v in headers.items():
        if v is not None:
            lines += _header_lines(k, v)
    lines += [f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = _HEAD.size + len(body) + 8
    head = _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 8, _EXTRA, 4, size)
    return head + body + struct.pack("<LL", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _record(kind, record_id, uri, refers, digest, size, date, payload: bytes) -> bytes:
    """The record of a row; the payload of a response behind an HTTP head, that of a revisit left out."""
    block, content, profile = payload, None, None
    if kind == "response":
        content = f"{_HTTP}; msgtype=response"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
        block = head.encode() + b"\r\n\r\n" + payload
    elif kind == "revisit":
        block, profile = b"", _PROFILE
    digest = digest or payload_digest(payload)
    return record_bytes(
        {
            "WARC-Type": kind,
            "WARC-Record-ID": f"<{record_id or uuid.uuid4().urn}>",
            "WARC-Date": date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "WARC-Target-URI": uri,
            "WARC-Refers-To": None if refers is None else f"<{refers}>",
            "WARC-Profile": profile,
            "WARC-Payload-Digest": digest if ":" in digest else f"sha1:{digest}",
            "Content-Type": content,
            "X-Payload-Length": str(len(payload) if size is None else size),
        },
        block,
    )


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int) -> None:
        self.path, self.max_bytes = path, max_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _open(self.path)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in iterator:
            columns = [batch[c].to_pylist() if c in batch.schema.names else [None] * len(batch) for c in _COLUMNS]
            for record_id, kind, uri, refers, digest, size_of, date, payload in zip(*columns, strict=True):
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = _record(kind, record_id, uri, refers, digest, size_of, date, payload or b"")
                out.write(member)
                size += len(member)
                if size >= self.max_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                store.delete_file(f"{root}/{name}")


_COLUMNS = (
    "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "record_date",
    "payload",
)


@dataclass
class _Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int) -> None:
        self.path, self.columns, self.split_bytes = path, schema.names, split_bytes
        self.types = schema
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name in _HEADERS:
                self.filters.append((name, "in", (f.value,)))
            elif isinstance(f, In) and name in _HEADERS:
                self.filters.append((name, "in", tuple(f.value)))
            elif isinstance(f, IsNotNull) and name in _HEADERS:
                self.filters.append((name, "set", ()))
            elif isinstance(f, IsNull) and name in _HEADERS:
                self.filters.append((name, "unset", ()))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        store, root = _open(self.path)
        found = []
        for i in store.get_file_info(pafs.FileSelector(root)):
            if i.base_name.startswith("manifest-"):
                found += json.loads(store.open_input_stream(i.path, compression=None).read())
            elif i.base_name.endswith((".warc", ".warc.gz")) and not _OWN.fullmatch(i.base_name):
                found.append((i.base_name, i.size))
        parts, names, size = [], [], 0
        for name, n in sorted(map(tuple, found)):
            names.append(name)
            size += n
            if size >= self.split_bytes:
                parts.append(_Files(names))
                names, size = [], 0
        return [*parts, _Files(names)] if names or not parts else parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.types)
        store, root = _open(self.path)
        rows: list[tuple] = []
        size = 0
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as file:
                for row in records(file, self.columns, self.filters):
                    rows.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes))
                    if len(rows) >= 4096 or size >= 8 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if len(schema) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _passes(row: dict, filters: list[tuple[str, str, tuple]]) -> bool:
    for name, kind, values in filters:
        value = row[name]
        if kind == "in" and value not in values:
            return False
        if kind == "set" and value is None or kind == "unset" and value is not None:
            return False
    return True


class _Archive:
    """The decoded bytes of an archive, plain or gzip members one after another."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at = file, file.size(), 0
        self.raw, self.pos = b"", 0  # read up to ``at``, used up to ``pos``
        self.data = bytearray()  # decoded and not taken
        self.inflate = None
        self.next: int | None = None  # where a member that carries its length ends

    def _fill(self, least: int) -> bool:
        while len(self.raw) - self.pos < least and self.at < self.size:
            got = self.file.read(min(_CHUNK, self.size - self.at))
            self.raw, self.pos, self.at = self.raw[self.pos :] + got, 0, self.at + len(got)
        return self.pos < len(self.raw)

    def _seek(self, at: int) -> None:
        """Goes on at ``at`` of the file, which is not behind what is used."""
        if at <= self.at:
            self.pos = len(self.raw) - (self.at - at)
        else:
            self.file.seek(at)
            self.raw, self.pos, self.at = b"", 0, at

    def more(self, step: int = _CHUNK) -> bool:
        """Decodes up to ``step`` more bytes of the file; false at its end."""
        if not self._fill(1 if self.inflate else _HEAD.size):
            if self.inflate:
                raise ValueError("the archive ends inside a gzip member")
            return False
        if not self.inflate and self.raw[self.pos : self.pos + 2] == b"\x1f\x8b":
            self.inflate, self.next = zlib.decompressobj(31), None
            if len(self.raw) - self.pos >= _HEAD.size:
                magic, _, _, _, _, extra, _, length = _HEAD.unpack_from(self.raw, self.pos)
                if magic == b"\x1f\x8b\x08\x04" and extra == _EXTRA:
                    self.next = self.at - len(self.raw) + self.pos + length
        piece = self.raw[self.pos : self.pos + step]
        self.pos += len(piece)
        self.data += self.inflate.decompress(piece) if self.inflate else piece
        if self.inflate and self.inflate.eof:
            self.pos -= len(self.inflate.unused_data)
            self.inflate = None
        return True

    def need(self, n: int) -> None:
        while len(self.data) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")

    def head(self) -> dict[str, str] | None:
        """The next record's headers by lower-case name, or none at the end."""
        self.next = None
        while not self.data or self.data[0] in b"\r\n":
            if self.data:
                del self.data[0]
            elif not self.more(1024):
                return None
        while (split := self.data.find(b"\r\n\r\n")) < 0:
            if not self.data.startswith(b"WARC/"[: len(self.data)]) or not self.more(1024):
                break
        if split < 0 or not self.data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {self.at} of the archive")
        text = re.sub(r"\r\n[ \t]+", " ", self.data[:split].decode(errors="replace"))
        del self.data[: split + 4]
        lines = (line.partition(":") for line in text.split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in lines}

    def drop(self, n: int) -> None:
        """Steps over the next ``n`` decoded bytes, the rest of the record."""
        if self.next is not None:
            self._seek(self.next)
            self.data.clear()
            self.inflate = None
            return
        while n > len(self.data):
            n -= len(self.data)
            self.data.clear()
            if self.inflate is None and self._fill(2) and self.raw[self.pos : self.pos + 2] != b"\x1f\x8b":
                start = self.at - len(self.raw) + self.pos
                if start + n > self.size:
                    raise ValueError("the archive ends inside a record")
                self._seek(start + n)
                return
            if not self.more():
                raise ValueError("the archive ends inside a record")
        del self.data[:n]


def _value(name: str, fields: dict[str, str]) -> str | None:
    exact = fields.get((_EXACT + name).lower())
    value = fields.get(name.lower()) if exact is None else unquote(exact)
    if value is None:
        return None
    if name in ("WARC-Record-ID", "WARC-Refers-To") and value[:1] == "<" and value[-1:] == ">":
        return value[1:-1]
    if name == "WARC-Payload-Digest" and value[:5].lower() == "sha1:":
        return value[5:]
    return value


def records(file, columns: list[str], filters: list[tuple[str, str, tuple]]) -> Iterator[tuple]:
    """The wanted columns of the records that pass; payloads of others are stepped over."""
    archive = _Archive(file)
    used = {*columns, *(name for name, _, _ in filters)}
    while (fields := archive.head()) is not None:
        row: dict = {c: _value(h, fields) for c, h in _HEADERS.items()}
        length, skip = int(fields["content-length"]), None

        def http_head() -> int:
            """Bytes of the block before the payload."""
            if not fields.get("content-type", "").lower().startswith(_HTTP):
                return 0
            while (end := archive.data.find(b"\r\n\r\n", 0, length)) < 0 and len(archive.data) < length:
                archive.need(min(length, len(archive.data) + 1))
            return length if end < 0 else end + 4

        if row["payload_bytes"] is not None:
            row["payload_bytes"] = int(row["payload_bytes"])
        elif "payload_bytes" in used and row["record_type"] != "revisit":
            skip = http_head()
            row["payload_bytes"] = length - skip
        if _passes(row, filters):
            if "payload" in columns:
                skip = http_head() if skip is None else skip
                archive.need(length)
                row["payload"] = bytes(archive.data[skip:length])
            yield tuple(row[c] for c in columns)
        archive.drop(length)


class WarcSource(DataSource):
    """``format("warc")``: options ``path``, ``max_bytes`` (write), ``split_bytes`` (read)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("split_bytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only ever added: use mode append")
        return _Writer(self.options["path"], int(self.options.get("max_bytes", 128 << 20)))


def base32(sha1: Column) -> Column:
    """Base32 of a SHA-1 in hex: five bytes give eight digits."""
    part = lambda i: F.lpad(F.conv(F.substring(sha1, 1 + 10 * i, 10), 16, 32), 8, "0")
    digits = F.concat(*(part(i) for i in range(4)))
    return F.translate(
        digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def write_pages(
    pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Pages as response records; of equal payloads all but the one with the least id are revisits.

    Payloads are equal if length, SHA-1 and SHA-256 are. Only these digests are
    grouped; rows that share payload and id are all responses.
    """
    spark = pages.sparkSession
    ship(spark)
    spark.dataSource.register(WarcSource)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    same = [F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256")]
    first = (
        pages.select(F.col(key).alias("id"), *same)
        .groupBy("sha1", "sha256")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    page = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("uri"), body.alias("payload"), *same)
    (
        rows.join(first, ["sha1", "sha256"], "left")
        .select(
            page("id").alias("record_id"),
            F.when(again, "revisit").otherwise("response").alias("record_type"),
            F.col("uri").alias("target_uri"),
            F.when(again, page("first_id")).alias("refers_to"),
            F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
            base32(F.col("sha1")).alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        )
        .write.format("warc")
        .option("path", folder)
        .mode("append")
        .save()
    )


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per record.

    Responses are read with their payload, which must match the header's digest and
    length; revisits are read by headers alone.
    """
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    headers = SCHEMA.replace(", payload binary", "")
    read = spark.read.format("warc").option("path", folder)
    whole = (F.octet_length("payload") == F.col("payload_bytes")) & (
        base32(F.sha1("payload")) == F.col("payload_digest")
    )
    full = read.load().where("record_type = 'response'")
    checked = F.when(whole, F.octet_length("payload").cast("long")).otherwise(
        F.raise_error(F.lit("a payload differs from its header"))
    )
    full = full.withColumn("payload_bytes", checked).drop("payload")
    light = read.schema(headers).load().where("record_type = 'revisit'")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return full.unionByName(light).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
