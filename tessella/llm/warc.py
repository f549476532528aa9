"""WARC 1.1 archives as a Spark data source in Python, and the archive of a table of pages.

``spark.dataSource.register(WarcDataSource)``, then ``spark.read.format("warc").load(path)`` or ``df.write.format("warc")``.

Reading: one partition for a run of files of about PARTITION_BYTES (writers start a new file before FILE_BYTES). Equality,
IN, prefix and null tests on the header columns are pushed down (spark.sql.python.filterPushdown.enabled): a record's
header block is parsed first, and the block of a record that fails them is sought over, neither read nor decoded. Option
payload=false does so for all records, for queries on headers alone.

Files ending in .gz hold gzip members, as the format asks for. The writer gives a record two members, its header block and
its block, and notes both lengths in the first one's extra field, so that here, too, a reader seeks over blocks; any other
reader takes them for one stream. Records of other writers are expanded member by member.

Writing: a task writes files under a name of its own; the driver moves those of tasks that succeeded, so lost or repeated
tasks leave no records behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from tessella.llm import common

#: Bytes after which a writer starts a new file; files that one partition reads together.
FILE_BYTES, PARTITION_BYTES = 64 << 20, 32 << 20
#: Bytes of payload in one Arrow batch.
BATCH_BYTES = 4 << 20
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
#: Header field of each column.
_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _FIELDS and isinstance(f, EqualTo | EqualNullSafe):
                self.tests.append(("in", name, frozenset([f.value])))
            elif name in _FIELDS and isinstance(f, In):
                self.tests.append(("in", name, frozenset(f.value)))
            elif name in _FIELDS and isinstance(f, StringStartsWith):
                self.tests.append(("prefix", name, f.value))
            elif name in _FIELDS and isinstance(f, IsNotNull | IsNull):
                self.tests.append(("null", name, isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        at, root = _open(self.path)
        found = sorted((x for x in at.get_file_info(fs.FileSelector(root, recursive=False)) if x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
        groups: list[list[str]] = []
        size = PARTITION_BYTES
        for x in found:
            if size + x.size > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [_Files(tuple(g)) for g in groups] or [_Files(())]

    def _wanted(self, header: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            there = header.get(_FIELDS[name])
            if kind == "null":
                ok = (there is None) == value
            elif kind == "in":
                ok = there in value if there is not None else None in value
            else:
                ok = there is not None and there.startswith(value)
            if not ok:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        at, _ = _open(self.path)
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with at.open_input_file(path) as raw:
                source = _source(raw, path.endswith(".gz"))
                while (header := source.header()) is not None:
                    length = int(header["content-length"])
                    if not self._wanted(header):
                        source.skip_block(length)
                        continue
                    payload, full = None, header.get("x-payload-length")
                    if self.payload:
                        payload = source.block(length)
                        if header.get("content-type", "").startswith("application/http"):
                            _, blank, body = payload.partition(b"\r\n\r\n")
                            payload = body if blank else payload  # a block without a header's end is all payload
                    else:
                        source.skip_block(length)
                    rows.append((*(header.get(f) for f in _FIELDS.values()), int(full) if full else None, payload))
                    size += len(payload or b"") + 300
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Buffered:
    """Reads ahead by STEP bytes and seeks over what isn't wanted."""

    STEP = 1 << 20

    def __init__(self, raw):
        self.raw, self.buffer, self.at = raw, b"", 0

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\r\n", self.at)) < 0:
            more = self.raw.read(self.STEP)
            if not more:
                return b""
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        out, self.at = self.buffer[self.at : end + 2], end + 2
        return out

    def take(self, n: int) -> bytes:
        have = self.buffer[self.at : self.at + n]
        self.at += len(have)
        return have if len(have) == n else have + self.raw.read(n - len(have))

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer) - self.at)
        self.at += have
        if n > have:
            self.raw.seek(self.raw.tell() + n - have)


def _fields(head: bytes) -> dict[str, str]:
    first, *rest = head.split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    out: dict[str, str] = {}
    for line in rest:
        name, _, value = line.decode().partition(":")
        if name:
            out[name.lower()] = value.strip()
    return out


class _Plain(_Buffered):
    """Records of a file that isn't compressed."""

    def header(self) -> dict[str, str] | None:
        head = [self.line()]
        while head == [b"\r\n"]:  # more blank lines than two after a record
            head = [self.line()]
        while head[-1] not in (b"", b"\r\n"):
            head.append(self.line())
        return _fields(b"".join(head)) if head[0] else None

    def block(self, length: int) -> bytes:
        out = self.take(length)
        if len(out) < length:
            raise ValueError(f"a WARC record ends after {len(out)} of {length} bytes")
        self.skip(4)
        return out

    def skip_block(self, length: int) -> None:
        self.skip(length + 4)


#: Fixed value: the first ten bytes of a gzip member that has an extra field, and the subfield of two lengths in it.
_GZIP, _LENGTHS = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"WR"


def _member(data: bytes, extra: bytes = b"") -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return _GZIP + struct.pack("<H", len(extra)) + extra + body


def zipped(head: bytes, block: bytes) -> bytes:
    """A record as two members."""
    second = _member(block + b"\r\n\r\n")
    size = len(_member(head)) + 20
    return _member(head, _LENGTHS + struct.pack("<HQQ", 16, size, len(second))) + second


class _Inflated:
    """The bytes of gzip members one after the other, however records are laid out in them; seeks forward only."""

    def __init__(self, raw):
        self.raw, self.unpacker, self.data, self.place = raw, zlib.decompressobj(31), b"", 0

    def read(self, n: int) -> bytes:
        out, have = [], 0
        while have < n:
            if self.unpacker.eof:
                self.data, self.unpacker = self.unpacker.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            data = self.data or self.raw.read(1 << 16)
            if not data:
                break
            out.append(self.unpacker.decompress(data, n - have))
            self.data = self.unpacker.unconsumed_tail
            have += len(out[-1])
        self.place += have
        return b"".join(out)

    def tell(self) -> int:
        return self.place

    def seek(self, place: int) -> None:
        while self.place < place and self.read(min(1 << 20, place - self.place)):
            pass


def _source(raw, gzip: bool) -> _Buffered:
    """Reader of a file: records of our own lengths are sought over, any other gzip file is one stream of records."""
    if not gzip:
        return _Plain(raw)
    start = raw.read(14)
    raw.seek(0)
    return _Zipped(raw) if start[:10] == _GZIP and start[12:14] == _LENGTHS else _Plain(_Inflated(raw))


class _Zipped(_Buffered):
    """Records of a file of gzip members that give their lengths; a file that was joined from such and other members fails."""

    def header(self) -> dict[str, str] | None:
        start = self.take(32)
        if not start:
            return None
        if start[:10] != _GZIP or start[12:14] != _LENGTHS:
            raise ValueError("a gzip member without lengths after members with them")
        size, self.second = struct.unpack_from("<QQ", start, 16)
        return _fields(zlib.decompress(start + self.take(size - 32), 31))

    def block(self, length: int) -> bytes:
        return zlib.decompress(self.take(self.second), 31)[:length]

    def skip_block(self, length: int) -> None:
        self.skip(self.second)


class WarcWriter(DataSourceArrowWriter):
    """Takes the columns of SCHEMA; payload_digest and payload_length are those of the full payload, which a revisit leaves out."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        at, root = _open(self.path)
        at.create_dir(f"{root}/_writing", recursive=True)
        paths, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                record = _record(row)
                if out is None or size + len(record) > FILE_BYTES:
                    if out:
                        out.close()
                    paths.append(f"{root}/_writing/{uuid.uuid4().hex}.warc.gz")
                    out, size = at.open_output_stream(paths[-1], compression=None), 0
                out.write(record)
                size += len(record)
        if out:
            out.close()
        return _Written(tuple(paths))

    def commit(self, messages: list) -> None:
        at, root = _open(self.path)
        for k, path in enumerate(p for m in messages if m for p in m.paths):
            at.move(path, f"{root}/part-{k:06d}.warc.gz")
        self._sweep()

    def abort(self, messages: list) -> None:
        self._sweep()

    def _sweep(self) -> None:
        at, root = _open(self.path)
        if at.get_file_info(f"{root}/_writing").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/_writing")


def _record(row: dict) -> bytes:
    payload = row["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (row["payload_length"] or 0)
    block = http + (payload or b"") if row["record_type"] == "response" else http
    names = ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest"), ("X-Payload-Length", "payload_length")
    lines = [f"{n}: {' '.join(str(row[c]).split())}" for n, c in names if row[c] is not None]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return zipped(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n", block)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


# ---------------------------------------------------------------- an archive of pages


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, least = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            name = lambda x: f"<urn:page:{'' if x is None else x}>"
            again = [m is not None and i != m for i, m in zip(ids, least, strict=True)]
            digest = [f"sha1:{base64.b32encode(bytes.fromhex(h)).decode()}" for h in batch.column(2).to_pylist()]
            payload = batch.column(4)
            yield pa.RecordBatch.from_arrays([pa.array([name(i) for i in ids], pa.string()), pa.array(["revisit" if a else "response" for a in again]), batch.column(1), pa.array([date] * len(ids)), pa.array([name(m) if a else None for a, m in zip(again, least, strict=True)], pa.string()), pa.array(digest), pa.array([len(p.as_py() or b"") for p in payload], pa.int64()), pa.array([None if a else p.as_py() for a, p in zip(again, payload, strict=True)], pa.binary())], schema=_ARROW)

    return run


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """A WARC record for each row of pages (page_id, url, html): a response, or a revisit of the smallest page_id whose
    payload of at least least_bytes is equal.

    A null html is empty, a null url gives no target header, a null page_id an empty name; rows that repeat the smallest id
    are responses each. Other columns aren't read; an empty table writes no file."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.length("payload").alias("n"), "payload")
    groups = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("least"), F.count("*").alias("k")).where("k > 1").select("digest", "n", "least")
    joined = rows.join(groups, ["digest", "n"], "left").select("page_id", "url", "digest", "least", "payload")
    pages.sparkSession.dataSource.register(WarcDataSource)
    joined.mapInArrow(_records(date), SCHEMA).write.format("warc").mode("append").save(path)


def read_records(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives in a folder; filters on header columns are pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [b.as_py() or b"" for b in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in data], pa.int64()), pa.array([base64.b32encode(hashlib.sha1(b).digest()).decode() for b in data])], names=["record_id", "payload_bytes", "payload_digest"])


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives at path and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A response's length and digest are taken from the payload read back, a revisit's from its header."""
    spark = pages.sparkSession
    write_pages(pages, path, least_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS long)")
    whole = read_records(spark, path).where("record_type = 'response'").select("record_id", "payload").mapInArrow(_digest, "record_id string, payload_bytes long, payload_digest string")
    whole = whole.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read_records(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return whole.unionByName(again)


def archive_folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{common.shared_dir(spark)}/tessella-warc-{uuid.uuid4().hex}"
