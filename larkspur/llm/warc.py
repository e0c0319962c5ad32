"""WARC archives as a Spark data source, for reading and writing.

Reading plans one partition for each archive file. Filters on record type, record id, target, digest and the
record referred to are pushed into the reader, which parses a record's headers first. A record that the
filters reject is not decoded any further, one of which no payload is wanted (option ``payload=false``) only to
the end of its HTTP headers: it is skipped by its length in a plain file; in a gzip file the member's length, which this writer states in the
member's extra field, tells where the next begins (members of other writers without it are read through).

Writing makes gzip members of one record each and starts a new file at ``max_file_bytes``. Files that a
failed or repeated task leaves behind are no part of the archive: the commit on the driver lists the files of
the tasks that count in a ``_files-….json`` of its own, and the reader goes by all such lists where there are any. So writes to one
folder add up, and one that fails changes nothing; one in mode ``overwrite`` removes the lists and files before it when its own list is there.

``archive`` prepares records: of equal payloads of at least ``min_bytes`` the row with the smallest key is the
response and the others revisit it; smaller ones are all responses. A null payload is an empty one. A row with
a null key can revisit but is never revisited (all are responses if their keys are all null); rows with the
same smallest key are all responses. A null target has no target header. An empty table gives an archive
without files. Payloads and targets of any length a column can hold are written and read whole, a record at a time. Other
columns are ignored, whatever their names; the key, payload and target columns are parameters.

Paths can be in any store that pyarrow's file systems open, the same on the driver and the executors.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

#: Lists of files: each write commits one of its own, a reader takes all of them.
LIST, LISTS = "_files-{}.json", re.compile(r"_files.*\.json")
#: Fixed values of the format: header names for the pushed-down columns.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in HEADER_OF],
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("http_headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)
ARROW = pa.schema(
    [
        *[pa.field(c, pa.string()) for c in HEADER_OF],
        pa.field("headers", pa.map_(pa.string(), pa.string())),
        pa.field("http_headers", pa.map_(pa.string(), pa.string())),
        pa.field("payload", pa.binary()),
        pa.field("path", pa.string()),
        pa.field("offset", pa.int64()),
    ]
)
HEAD_BYTES = 4096


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


# -- format -----------------------------------------------------------------------------------------------


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    """First line, and the fields by lower-case name; a folded line continues the one before."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return first, out


def _clean(value: str) -> str:
    """Control characters would end a header line; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, record_type: str, date: str, target: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One record of an HTTP response; a revisit has the HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = [f"WARC/1.1\r\nWARC-Type: {record_type}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}"]
    if target is not None:
        head.append(f"WARC-Target-URI: {_clean(target)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{refers_to}>\r\nWARC-Profile: {REVISIT_PROFILE}")
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n")
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` holds its whole length and that of the data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    deflated = pack.compress(data) + pack.flush()
    total = 10 + 2 + 12 + len(deflated) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + deflated + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_length(head: bytes) -> int | None:
    """Length of the member that begins here, if its extra field tells."""
    if len(head) >= 24 and head[3] & 4:
        (n,) = struct.unpack_from("<H", head, 10)
        i = 12
        while i + 4 <= 12 + n:
            (size,) = struct.unpack_from("<H", head, i + 2)
            if head[i : i + 2] == b"sl" and size == 8:
                return struct.unpack_from("<I", head, i + 4)[0]
            i += 4 + size
    return None


@dataclass
class Wanted:
    """What the reader keeps: sets of accepted values and prefixes, by column."""

    equal: dict[str, set[str]]
    starts: dict[str, list[str]]
    payload: bool

    def accepts(self, fields: dict[str, str]) -> bool:
        for c, values in self.equal.items():
            if _value(c, fields) not in values:
                return False
        return all((v := _value(c, fields)) is not None and all(v.startswith(p) for p in starts) for c, starts in self.starts.items())


def _value(column: str, fields: dict[str, str]) -> str | None:
    v = fields.get(HEADER_OF[column])
    return v[1:-1] if v is not None and column in ("record_id", "refers_to") and v[:1] == "<" and v[-1:] == ">" else v


def _row(fields: dict[str, str], body: bytes | None, path: str, offset: int) -> tuple:
    http, payload = {}, body
    if body is not None and fields.get("content-type", "").startswith("application/http"):
        head, found, rest = body.partition(b"\r\n\r\n")
        if found:
            http, payload = _headers(head)[1], rest
    return (*[_value(c, fields) for c in HEADER_OF], list(fields.items()), list(http.items()), payload, path, offset)


def read_records(stream: pa.NativeFile, path: str, wanted: Wanted) -> Iterator[tuple]:
    """Rows of one archive file, plain or gzip."""
    start = stream.read(2)
    stream.seek(0)
    yield from (_gzip_records if start == b"\x1f\x8b" else _plain_records)(stream, path, wanted)


def _plain_records(stream: pa.NativeFile, path: str, wanted: Wanted) -> Iterator[tuple]:
    size, at = stream.size(), 0
    while at < size:
        stream.seek(at)
        head = b""
        while b"\r\n\r\n" not in head and at + len(head) < size:
            head += stream.read(HEAD_BYTES)
        block, found, rest = head.partition(b"\r\n\r\n")
        if not found:
            if block.strip():
                raise ValueError(f"{path}: a record without an end of headers at {at}")
            return
        first, fields = _headers(block.lstrip(b"\r\n"))
        if not first.startswith("WARC/"):
            raise ValueError(f"{path}: no record at {at}")
        n = int(fields.get("content-length", 0))
        if wanted.accepts(fields):
            body = rest[:n]
            while len(body) < n and (wanted.payload or _head_is_open(body)):
                more = stream.read(n - len(body) if wanted.payload else min(HEAD_BYTES, n - len(body)))
                if not more:
                    raise ValueError(f"{path}: a record ends early at {at}")
                body += more
            yield _row(fields, body if wanted.payload else _http_head(body), path, at)
        at += len(block) + 4 + n + 4


def _head_is_open(body: bytes) -> bool:
    """Whether what is read of a body so far may be the beginning of a longer HTTP head."""
    return b"HTTP/".startswith(body[:5]) and b"\r\n\r\n" not in body


def _http_head(body: bytes) -> bytes | None:
    head, found, _ = body.partition(b"\r\n\r\n")
    return head + found if found and body.startswith(b"HTTP/") else None


def _gzip_records(stream: pa.NativeFile, path: str, wanted: Wanted) -> Iterator[tuple]:
    size, at = stream.size(), 0
    while at < size:
        stream.seek(at)
        raw = stream.read(HEAD_BYTES)
        length = _member_length(raw)
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(raw)
        while b"\r\n\r\n" not in data and not unpack.eof:
            more = stream.read(HEAD_BYTES)
            if not more:
                raise ValueError(f"{path}: a member ends early at {at}")
            data += unpack.decompress(more)
        block, _, rest = data.partition(b"\r\n\r\n")
        first, fields = _headers(block)
        if not first.startswith("WARC/"):
            raise ValueError(f"{path}: no record at {at}")
        keep, n = wanted.accepts(fields), int(fields.get("content-length", 0))
        if length is None or (keep and wanted.payload):
            parts, read = [rest], stream.tell()
            while not unpack.eof:
                more = stream.read(1 << 16 if length is None else max(1, at + length - read))
                if not more:
                    raise ValueError(f"{path}: a member ends early at {at}")
                read += len(more)
                parts.append(unpack.decompress(more))
            length = length or read - len(unpack.unused_data) - at
            rest = b"".join(parts)
        elif keep:
            while len(rest) < n and _head_is_open(rest) and not unpack.eof:
                more = stream.read(HEAD_BYTES)
                if not more:
                    raise ValueError(f"{path}: a member ends early at {at}")
                rest += unpack.decompress(more)
        if keep:
            yield _row(fields, rest[:n] if wanted.payload else _http_head(rest[:n]), path, at)
        at += length


# -- data source --------------------------------------------------------------------------------------------


@dataclass
class FilePartition(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.wanted = Wanted({}, {}, options.get("payload", "true").lower() != "false")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            c = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if c in HEADER_OF and isinstance(f, EqualTo):
                self.wanted.equal[c] = self.wanted.equal.get(c, {f.value}) & {f.value}
            elif c in HEADER_OF and isinstance(f, In):
                self.wanted.equal[c] = self.wanted.equal.get(c, set(f.value)) & set(f.value)
            elif c in HEADER_OF and isinstance(f, StringStartsWith):
                self.wanted.starts.setdefault(c, []).append(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, path = _open(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [FilePartition(self.path)]
        base = self.path.rstrip("/")
        return [FilePartition(f"{base}/{n}") for n in _committed(system, path)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = _open(partition.path)
        with system.open_input_file(path) as stream:
            rows, held = [], 0
            for row in read_records(stream, partition.path, self.wanted):
                rows.append(row)
                held += len(row[-3] or b"") + 500
                if held > 4_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _lists(system: fs.FileSystem, path: str) -> list[str]:
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if LISTS.fullmatch(x.base_name))


def _listed(system: fs.FileSystem, path: str, lists: list[str]) -> list[str]:
    names: set[str] = set()
    for name in lists:
        with system.open_input_stream(f"{path}/{name}") as f:
            names |= set(json.loads(f.read()))
    return sorted(names)


def _committed(system: fs.FileSystem, path: str) -> list[str]:
    """The archives of a folder: those on any write's list, or all where there is no list."""
    if lists := _lists(system, path):
        return _listed(system, path, lists)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if re.search(r"\.warc(\.gz)?$", x.base_name))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.overwrite = overwrite
        self.path = options["path"].rstrip("/")
        system, path = _open(self.path)
        # Archives of other writers, in a folder without a list: they stay readable when it gets one.
        self.unlisted = [] if overwrite or _lists(system, path) else _committed(system, path)
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.level = int(options.get("level", 6))
        self.max_bytes = int(options.get("max_file_bytes", 64_000_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        names: list[str] = []
        out, held = None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    system.create_dir(path, recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = member(record(r["record_id"], r["record_type"], self.date, r["target_uri"], r["payload_digest"], r["payload_bytes"], r["payload"], r["refers_to"]), self.level)
                out.write(data)
                held += len(data)
                if held >= self.max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        before = _lists(system, path)
        names = sorted({*self.unlisted, *(n for m in messages if m for n in m.names)})
        with system.open_output_stream(f"{path}/{LIST.format(uuid.uuid4().hex)}", compression=None) as f:
            f.write(json.dumps(names).encode())
        if self.overwrite:
            gone = set(_listed(system, path, before)) - set(names)
            for n in [*before, *sorted(gone)]:
                system.delete_file(f"{path}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        for n in (n for m in messages if m for n in m.names):
            if system.get_file_info(f"{path}/{n}").type == fs.FileType.File:
                system.delete_file(f"{path}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session, and let filters reach Python readers."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- records ------------------------------------------------------------------------------------------------


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", target: str = "url", min_bytes: int = 100) -> DataFrame:
    """The records of a table of pages, as the writer takes them."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("_key"), F.col(target).alias("target_uri"), body.alias("payload"), F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    found = rows.where((F.col("payload_bytes") >= min_bytes)).groupBy("payload_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull())
    # The second key keeps both sides exchanged for the join, so that a hot payload's partition can be split.
    meet = F.xxhash64("payload_digest")
    joined = rows.withColumn("_m", meet).join(found.select("payload_digest", "_first", meet.alias("_m")), ["_m", "payload_digest"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first"))
    return joined.select(
        urn(F.col("_key")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, urn(F.col("_first"))).alias("refers_to"),
    )


def urn(key: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("")))


def key_of(record_id: Column) -> Column:
    """The key in a record id; null for a null key or another kind of id."""
    return F.regexp_extract(record_id, "^urn:page:(.+)$", 1).try_cast("long")


def write(records: DataFrame, path: str, **options: str) -> None:
    """Add records to a folder: readers find those of every write that was committed."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


#: DuckDB SQL for the query op3.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
