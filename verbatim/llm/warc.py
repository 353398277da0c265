"""WARC archives as a PySpark Python data source.

Writing: every task writes archives of its own and the driver moves the archives of the successful attempts into place, so a
lost executor or a repeated task leaves nothing behind. Reading: files are planned into partitions by size; record type and
other header predicates of the query reach the reader as filters; headers are parsed first, and the payload of a record that
fails a filter is skipped by seeking over its length. Compressed archives hold one gzip member per record, whose extra field
``sl`` names its length: only the first part of a member is inflated for the headers, and an unwanted rest is seeked over
too. Members without that field, from other writers, are inflated but not decoded.

Paths go through Arrow's file systems, so a local path on shared storage, HDFS or an object store all work.

Defined results: a null payload is written as an empty one; line ends in header values are percent-encoded; null values
write no header and read back as null; an empty table writes no file and reads back as no row; other columns are ignored.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

#: Column, WARC header. The order is that of the file.
HEADERS = (
    ("record_type", "WARC-Type"),
    ("record_id", "WARC-Record-ID"),
    ("target_uri", "WARC-Target-URI"),
    ("date", "WARC-Date"),
    ("payload_digest", "WARC-Payload-Digest"),
    ("refers_to", "WARC-Refers-To"),
    ("profile", "WARC-Profile"),
    ("payload_bytes", "WARC-Full-Payload-Length"),
)
SCHEMA = ", ".join(f"{c} {'bigint' if c == 'payload_bytes' else 'string'}" for c, _ in HEADERS) + ", payload binary"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
COLUMN_OF = {h.lower(): c for c, h in HEADERS}


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(value: object) -> str:
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restore(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(row: dict) -> bytes:
    payload = row["payload"] or b""
    lines = [f"{h}: {_clean(row[c])}\r\n" for c, h in HEADERS if row[c] is not None]
    head = VERSION + "".join(lines).encode() + b"Content-Length: %d\r\n\r\n" % len(payload)
    return head + payload + b"\r\n\r\n"


#: Start of a gzip member: magic, deflate, flag "extra field", no time, unknown system (fixed value).
GZIP_START = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


def member(data: bytes) -> bytes:
    """A gzip member with the lengths of its deflated and of its plain data in the extra field ``sl``."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    if max(len(body), len(data)) >= 1 << 32:
        extra = b""
    else:
        extra = b"sl" + struct.pack("<HII", 8, len(body), len(data))
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP_START + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Options: ``path``; ``compression`` none or gzip (one member per record); ``file_bytes`` at which a new file starts."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.gzip = options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", 1 << 30))
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, root = open_fs(self.path)
        pending = posixpath.join(root, self.pending)
        fs.create_dir(pending, recursive=True)
        done, out, size = Written(), None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}"
                    out, size = fs.open_output_stream(posixpath.join(pending, name), compression=None), 0
                    done.files.append(name)
                data = record_bytes(row)
                data = member(data) if self.gzip else data
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.move(posixpath.join(root, self.pending, name), posixpath.join(root, name))
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        pending = posixpath.join(root, self.pending)
        if fs.get_file_info(pending).type == FileType.Directory:
            fs.delete_dir(pending)


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    """Options: ``path``; ``split_bytes`` of files per partition; ``payload`` false leaves every payload unread."""

    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 128 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.columns = [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list):
        """Takes equality, membership, prefix and presence of a header; the rest stays with Spark."""
        text = {c for c, _ in HEADERS} - {"payload_bytes"}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in text and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name in text and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name in text and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in text and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        fs, root = open_fs(self.path)
        info = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=False))
        files = sorted((f.path, f.size) for f in info if f.type == pafs.FileType.File and ".warc" in f.base_name)
        parts: list[Files] = []
        room = 0
        for name, size in files:
            if not parts or size > room:
                parts.append(Files([]))
                room = self.split_bytes
            parts[-1].names.append(name)
            room -= size
        return parts or [Files([])]

    def wanted(self, head: dict) -> bool:
        for name, kind, value in self.tests:
            got = head.get(name)
            if got is None or kind == "in" and got not in value or kind == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: Files):
        import pyarrow as pa

        fs, _ = open_fs(self.path)
        types = {c: pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in self.columns}
        schema = pa.schema(list(types.items()))
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as raw:
                with io.BufferedReader(_Seekable(raw), 1 << 18) as f:
                    for head, payload in self._members(f, name) if name.endswith(".gz") else self._records(f, name):
                        rows.append({**head, "payload": payload})
                        held += len(payload or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _head(block: bytes, name: str) -> tuple[dict, int]:
        """Columns and payload length, from the lines before the blank one."""
        first, *lines = block.split(b"\r\n")
        if first + b"\r\n" != VERSION:
            raise ValueError(f"no record where one should begin, in {name}: {first[:40]!r}")
        head: dict = {}
        length = None
        for line in lines:
            key, _, value = line.decode("utf-8").partition(": ")
            if key.lower() == "content-length":
                length = int(value)
            elif column := COLUMN_OF.get(key.lower()):
                head[column] = _restore(value)
        if length is None:
            raise ValueError(f"a record without a length in {name}")
        if "payload_bytes" in head:
            head["payload_bytes"] = int(head["payload_bytes"])
        return head, length

    def _records(self, f, name: str):
        """Records of a plain archive."""
        while line := f.readline():
            if line == b"\r\n":
                continue
            block = [line]
            while (line := f.readline()) not in (b"\r\n", b""):
                block.append(line)
            head, length = self._head(b"".join(block)[:-2], name)
            if not self.wanted(head):
                _skip(f, length)
            elif self.payload:
                yield head, f.read(length)
            else:
                _skip(f, length)
                yield head, None

    def _members(self, f, name: str):
        """Records of a compressed archive: one per gzip member with ``sl`` lengths, any number in the others."""
        while start := f.read(12):
            extra = b""
            if start[:3] == GZIP_START[:3] and start[3] == 4:
                extra = f.read(struct.unpack("<H", start[10:])[0])
            if extra[:4] != b"sl\x08\0" or len(extra) != 12:
                f.seek(-len(start) - len(extra), io.SEEK_CUR)
                yield from self._records(io.BufferedReader(_Inflated(f, name), 1 << 16), name)
                continue
            left, inflate, data = struct.unpack("<I", extra[4:8])[0], zlib.decompressobj(-15), b""
            while b"\r\n\r\n" not in data and left:
                part = f.read(min(left, 1024))
                left -= len(part)
                data += inflate.decompress(part)
            block, _, rest = data.partition(b"\r\n\r\n")
            head, length = self._head(block, name)
            take = self.wanted(head)
            if take and self.payload:
                rest = (rest + inflate.decompress(f.read(left)))[:length]
                f.seek(8, io.SEEK_CUR)
            else:
                f.seek(left + 8, io.SEEK_CUR)
            if take:
                yield head, rest if self.payload else None


def _skip(f, size: int) -> None:
    if f.seekable():
        f.seek(size, io.SEEK_CUR)
        return
    while size and (data := f.read(min(size, 1 << 16))):
        size -= len(data)


class _Inflated(io.RawIOBase):
    """The gzip members from here up to one with ``sl`` lengths, as one stream inflated a piece at a time."""

    def __init__(self, f, name: str):
        self.f, self.name, self.data = f, name, b""
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def _next_member(self) -> bool:
        self.f.seek(-len(self.inflate.unused_data), io.SEEK_CUR)
        start = self.f.read(24)
        self.f.seek(-len(start), io.SEEK_CUR)
        lengths = start[:3] == GZIP_START[:3] and start[3:4] == b"\4" and start[10:16] == b"\x0c\0sl\x08\0"
        self.inflate = zlib.decompressobj(31) if start and not lengths else None
        return self.inflate is not None

    def readinto(self, buffer) -> int:
        while not self.data:
            if self.inflate is None or self.inflate.eof and not self._next_member():
                return 0
            packed = self.inflate.unconsumed_tail or self.f.read(1 << 16)
            self.data = self.inflate.decompress(packed, 1 << 18)
            if not packed and not self.data and not self.inflate.eof:
                raise ValueError(f"a gzip member without an end in {self.name}")
        n = min(len(buffer), len(self.data))
        buffer[:n], self.data = self.data[:n], self.data[n:]
        return n


class _Seekable(io.RawIOBase):
    """An Arrow file as a raw stream, so that Python's buffering and line reading work on it."""

    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.raw.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        if whence == io.SEEK_CUR:
            offset += self.raw.tell()
        elif whence == io.SEEK_END:
            offset += self.raw.size()
        self.raw.seek(offset)
        return offset

    def tell(self) -> int:
        return self.raw.tell()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: The digits of base 32 as ``conv`` writes them, and as archives write them (fixed values).
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def records_of(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The rows to write: a response per distinct payload, the smallest key's, and revisits of it.

    Only ids and digests are grouped and joined, so payloads move once, spread by id; a payload that a third of all pages
    share makes many slim rows of one key, which combine before the shuffle and which the join can split. Rows that
    share the smallest id of a payload are all responses; among null keys only, all are responses.
    """
    rows = pages.select(
        F.col(key).alias("k"), F.col(url).alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.length("payload").cast("long"))
    slim = rows.filter(F.col("payload_bytes") >= least_bytes).select("k", "payload_digest", "payload_bytes")
    firsts = (
        slim.groupBy("payload_digest", "payload_bytes")
        .agg(F.min("k").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
    )
    again = slim.join(firsts, ["payload_digest", "payload_bytes"]).filter(~F.col("k").eqNullSafe(F.col("first")))
    again = again.select("k", "payload_digest", "first").distinct()
    same = F.col("p.k").eqNullSafe(F.col("a.k")) & (F.col("p.payload_digest") == F.col("a.payload_digest"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("a.first").isNotNull()
    return (
        rows.alias("p")
        .join(again.alias("a"), same, "left")
        .select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            urn(F.col("p.k")).alias("record_id"),
            "p.target_uri",
            F.lit("2024-01-01T00:00:00Z").alias("date"),
            F.concat(F.lit("sha1:"), F.col("p.payload_digest")).alias("payload_digest"),
            F.when(revisit, urn(F.col("a.first"))).alias("refers_to"),
            F.when(revisit, F.lit(SAME_PAYLOAD)).alias("profile"),
            F.col("p.payload_bytes").alias("payload_bytes"),
            F.when(~revisit, F.col("p.payload")).alias("payload"),
        )
    )


def key_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
