"""Web archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = "file string, offset bigint, type string, record_id string, date string, uri string, content_type string, content_length bigint, headers map<string,string>, payload binary, body string"
SPLIT = 128 << 20  #: bytes of files that one task reads
PIECES = 64  #: ranges of one file at most: each task hops over the heads of the records before its range
READ = 256 << 10  #: bytes read from a file at once
ROLL = 256 << 20  #: bytes after which a writing task begins another file
_NAMES = {"type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "uri": "warc-target-uri", "content_type": "content-type"}
_BATCH = 8 << 20


class Malformed(ValueError):
    """A record that isn't one; says the file and the offset."""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _parse(head: bytes, where: str) -> dict[str, str]:
    """Headers by lower-case name; folded lines are joined, the last of repeated names counts."""
    lines = head.replace(b"\r\n", b"\n").split(b"\n")
    if not lines[0].startswith(b"WARC/"):
        raise Malformed(f"no record begins at {where}")
    found: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
        elif line:
            name, colon, value = line.partition(b":")
            if not colon:
                raise Malformed(f"a header without a colon at {where}")
            last = name.strip().lower().decode("utf-8", "replace")
            found[last] = value.strip().decode("utf-8", "replace")
    if not found.get("content-length", "").isdigit():
        raise Malformed(f"no content length at {where}")
    return found


def _head_end(data: bytes) -> int:
    """Offset after the blank line that ends the headers; -1 if it isn't there."""
    ends = [i + n for i, n in ((data.find(b"\r\n\r\n"), 4), (data.find(b"\n\n"), 2)) if i >= 0]
    return min(ends, default=-1)


class _Plain:
    """Records of an uncompressed file: headers are read, a payload only if asked for, else sought past."""

    def __init__(self, f, size: int, name: str):
        self.f, self.size, self.name = f, size, name

    def head(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Headers, start of the payload and of the next record."""
        data, step = b"", 1024
        while (end := _head_end(data.lstrip(b"\r\n"))) < 0:
            self.f.seek(at + len(data))
            more = self.f.read(step)
            if not more:
                if data.strip(b"\r\n"):
                    raise Malformed(f"headers end too early at {self.name}:{at}")
                return None
            data, step = data + more, step * 2
        skip = len(data) - len(data.lstrip(b"\r\n"))
        headers = _parse(data[skip : skip + end], f"{self.name}:{at}")
        start = at + skip + end
        if start + int(headers["content-length"]) > self.size:
            raise Malformed(f"a payload ends too early at {self.name}:{at}")
        return headers, start, start + int(headers["content-length"])

    def payload(self, headers: dict[str, str], start: int) -> bytes:
        self.f.seek(start)
        return self.f.read(int(headers["content-length"]))

    def skip(self, at: int) -> int | None:
        """Where the record after the one at ``at`` may begin; None at the end."""
        found = self.head(at)
        return None if found is None else found[2]


def _lengths(raw: bytes) -> tuple[int, int]:
    """Bytes of a gzip member and of its contents, by the ``sl`` field of its header; zeros without it."""
    return struct.unpack("<II", raw[16:24]) if len(raw) >= 24 and raw[3] & 4 and raw[12:16] == b"sl\x08\x00" else (0, 0)


class _Gzip:
    """Records each compressed by itself, or several in a gzip member. Inflates up to the end of the headers; the
    rest only if the payload is asked for, or if no ``sl`` field in the gzip header tells that the member holds
    one record and where it ends."""

    def __init__(self, f, size: int, name: str):
        self.f, self.size, self.name = f, size, name

    def head(self, at: int) -> tuple[dict[str, str], int, int] | None:
        self.f.seek(at)
        raw = self.f.read(4096)
        if not raw:
            return None
        if raw[:2] != b"\x1f\x8b":
            raise Malformed(f"no gzip member begins at {self.name}:{at}")
        length, whole = _lengths(raw)
        self.z, self.out, self.at = zlib.decompressobj(31), b"", at + len(raw)
        self.left = raw
        while (end := _head_end(self.out)) < 0:
            if not self._more(4096):
                raise Malformed(f"headers end too early at {self.name}:{at}")
        headers = _parse(self.out[:end], f"{self.name}:{at}")
        self.start = end
        alone = length and whole == (end + int(headers["content-length"]) + 4) & 0xFFFFFFFF  # nothing but its last line breaks
        return headers, at, at + length if alone else -1

    def inner(self, at: int) -> tuple[dict[str, str], int, int]:
        """The record that begins where the inflated bytes do, in the member at ``at``."""
        while (end := _head_end(self.out)) < 0:
            if not self._more(4096):
                raise Malformed(f"headers end too early in {self.name}:{at}")
        self.start = end
        return _parse(self.out[:end], f"{self.name}:{at}"), at, -1

    def after(self, headers: dict[str, str]) -> bool:
        """Pass over what is left of the payload and over line breaks; whether another record of the member follows."""
        left = self.start + int(headers["content-length"]) - len(self.out)
        rest = b"" if left >= 0 else self.out[left:]
        while left > 0:
            self.out = b""
            if not self._more(min(left, 1 << 20)):
                raise Malformed(f"a payload ends too early in {self.name}")
            left -= len(self.out)
        while not (rest := rest.lstrip(b"\r\n")):
            self.out = b""
            if not self._more(4096):
                return False
            rest = self.out
        self.out = rest
        return True

    def skip(self, at: int) -> int | None:
        """Where the member after the one at ``at`` begins, from its header alone if that tells; None at the end."""
        self.f.seek(at)
        raw = self.f.read(24)
        if not raw:
            return None
        if raw[:2] == b"\x1f\x8b" and (length := _lengths(raw)[0]):
            return at + length
        self.head(at)
        return self.end()

    def _more(self, most: int) -> bool:
        """Inflate up to ``most`` more bytes; whether there were any."""
        if self.z.eof:
            return False
        if not self.left:
            self.left = self.f.read(65_536)
            self.at += len(self.left)
            if not self.left:
                raise Malformed(f"{self.name} ends within a gzip member")
        got = self.z.decompress(self.left, most)
        self.left = self.z.unconsumed_tail
        self.out += got
        return bool(got) or not self.z.eof

    def payload(self, headers: dict[str, str], start: int) -> bytes:
        need = self.start + int(headers["content-length"])
        parts = [self.out]
        have = len(self.out)
        while have < need:
            self.out = b""
            if not self._more(1 << 20):
                raise Malformed(f"a payload ends too early at {self.name}:{start}")
            parts.append(self.out)
            have += len(self.out)
        self.out = b"".join(parts)
        return self.out[self.start : need]

    def end(self) -> int:
        """Where the member ends, found by inflating what is left of it without keeping it."""
        while not self.z.eof:
            self.out = b""
            self._more(1 << 20)
        return self.at - len(self.z.unused_data)


@dataclass
class Piece(InputPartition):
    """Byte ranges of files; a task reads the records, or gzip members, that begin in them."""

    ranges: list[tuple[str, int, int]]


def _text(headers: dict[str, str], payload: bytes) -> str:
    """An HTTP message's body, or the payload itself, as UTF-8 with replacements."""
    if headers.get("content-type", "").startswith("application/http") and (end := _head_end(payload)) >= 0:
        payload = payload[end:]
    return payload.decode("utf-8", "replace")


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.drop = options.get("mode", "failfast").lower() == "dropmalformed"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters on columns that come from the headers; Spark applies the others, and need not
        apply these again, as every record returned has passed them."""
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", IsNull: "null", IsNotNull: "some"}
        for f in filters:
            kind = kinds.get(type(f))
            column = f.attribute[0] if kind and len(f.attribute) == 1 else ""
            if column in (*_NAMES, "content_length"):
                self.tests.append((column, kind, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            v = int(headers["content-length"]) if column == "content_length" else headers.get(_NAMES[column])
            if kind in ("null", "some"):
                ok = (v is None) == (kind == "null")
            elif v is None:
                ok = False
            else:
                ok = {"eq": lambda: v == value, "in": lambda: v in value, "starts": lambda: v.startswith(value), "ends": lambda: v.endswith(value), "contains": lambda: value in v, "gt": lambda: v > value, "ge": lambda: v >= value, "lt": lambda: v < value, "le": lambda: v <= value}[kind]()
            if not ok:
                return False
        return True

    def partitions(self) -> list[Piece]:
        """Small files together, up to ``splitBytes``. Larger files whose records can be hopped over are cut into ranges
        of so many bytes, PIECES at most; the tasks find the records that begin in their ranges. Here no record is
        read, but the first 24 bytes of each large compressed file."""
        system, root = _open(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
        pieces: list[list[tuple[str, int, int]]] = [[]]
        room = self.split
        for f in sorted((f for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            for start, end in [(0, f.size)] if f.size <= self.split else self._cuts(system, f):
                if end - start > room and pieces[-1]:
                    pieces.append([])
                    room = self.split
                pieces[-1].append((f.path, start, end))
                room -= end - start
        return [Piece(p) for p in pieces if p] or [Piece([])]

    def _cuts(self, system: fs.FileSystem, f: fs.FileInfo) -> list[tuple[int, int]]:
        if f.path.endswith(".gz"):
            with system.open_input_file(f.path) as g:
                if not _lengths(g.read(24))[0]:
                    return [(0, f.size)]  # without lengths only inflating finds the members
        step = max(self.split, -(-f.size // PIECES))
        return [(at, min(at + step, f.size)) for at in range(0, f.size, step)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        kinds = {"offset": pa.int64(), "content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        decode = {"payload", "body"} & set(self.columns)
        system, _ = _open(self.path)
        rows: list[list] = [[] for _ in self.columns]
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, kinds.get(c, pa.string())) for c, v in zip(self.columns, rows)], names=self.columns)

        for path, low, to in piece.ranges:
            with system.open_input_file(path) as f:
                r = (_Gzip if path.endswith(".gz") else _Plain)(io.BufferedReader(f, READ), f.size(), path)
                try:
                    at: int | None = 0
                    while at is not None and at < low:  # from head to head; what begins in a payload is no record
                        at = r.skip(at)
                    h = r.head(at) if at is not None and at < to else None
                    while h is not None:
                        headers, start, after = h
                        if self.wanted(headers):
                            payload = r.payload(headers, start) if decode else b""
                            values = {"file": path, "offset": at, "content_length": int(headers["content-length"]), "headers": list(headers.items()), "payload": payload}
                            values |= {c: headers.get(n) for c, n in _NAMES.items()}
                            if "body" in decode:
                                values["body"] = _text(headers, payload)
                            for c, v in zip(self.columns, rows):
                                v.append(values[c])
                            size += len(payload) + 200
                        if after < 0 and r.after(headers):
                            h = r.inner(at)
                        else:
                            at = after if after >= 0 else r.end()
                            h = r.head(at) if at < to else None
                        if size > _BATCH:
                            yield batch()
                            rows, size = [[] for _ in self.columns], 0
                except (Malformed, zlib.error):
                    if not self.drop:
                        raise
        if size:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def record(kind: str, uri: str | None, date: str, content_type: str, payload: bytes, extra: list[tuple[str, str]], record_id: str) -> bytes:
    """One record; line breaks in header values are written as %0D and %0A, since a header is a line."""
    heads = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri is not None else []), ("Content-Type", content_type), *extra, ("Content-Length", str(len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in ((k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in heads))
    return b"".join([b"WARC/1.1\r\n", lines.encode(), b"\r\n", payload, b"\r\n\r\n"])


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header has an ``sl`` field: the lengths of the member and of its contents."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    total = 24 + len(packed) + 8
    extra = b"sl\x08\x00" + struct.pack("<II", total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"".join([b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H", len(extra)), extra, packed, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)])


class WarcWriter(DataSourceArrowWriter):
    """Columns ``type, uri, date, content_type, payload`` and ``headers`` (more headers). Each task writes
    files under names of its own, which get their final names when the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gzip, self.overwrite = options["path"], options.get("compression", "gzip") == "gzip", overwrite
        self.roll = int(options.get("rollBytes", ROLL))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        pack = member if self.gzip else bytes
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name = f"{root}/part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    files.append((name + ".part", name))
                    out, size = system.open_output_stream(name + ".part"), 0
                    size += out.write(pack(record("warcinfo", None, row["date"], "application/warc-fields", b"format: WARC File Format 1.1\r\n", [], f"<urn:uuid:{uuid.uuid4()}>")))
                extra = [(k, v) for k, v in (row.get("headers") or []) if v is not None]
                size += out.write(pack(record(row["type"], row["uri"], row["date"], row["content_type"], row["payload"] or b"", extra, f"<urn:uuid:{uuid.uuid4()}>")))
                if size >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        new = [f for m in messages if m for f in m.files]
        if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            keep = {a for a, _ in new}
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.path not in keep and f.path.endswith((".warc", ".warc.gz", ".part")):
                    system.delete_file(f.path)
        for a, b in new:
            system.move(a, b)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for a, _ in m.files if m else ():
                system.delete_file(a)


class WarcSource(DataSource):
    """Options: ``path`` (a file or folder of ``.warc`` and ``.warc.gz``), ``splitBytes``, ``mode`` (failfast,
    or dropmalformed: leave a file at its first damage), ``compression`` (gzip, none), ``rollBytes``. A schema
    with some of the columns only reads these; without ``payload`` and ``body`` no payload is inflated or
    decoded. Filters reach the headers with ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows for the writer: a request and a response for every page ``(page_id, url, html)``. A page of null
    html has a request only; a null url or id is left out of the headers. An empty page has an empty payload, a very
    long one is written whole; repeated rows are written again; other columns don't matter; no rows give none."""
    html, url = F.col("html"), F.col("url")
    ids = F.when(F.col("page_id").isNotNull(), F.create_map(F.lit("Page-Id"), F.col("page_id").cast("string")))
    body = F.encode(html, "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))

    def row(kind: str, payload) -> F.Column:
        return F.struct(F.lit(kind).alias("type"), url.alias("uri"), F.lit(date).alias("date"), F.lit(f"application/http; msgtype={kind}").alias("content_type"), ids.alias("headers"), payload.alias("payload"))

    request = F.encode(F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), "UTF-8")
    rows = F.array(row("request", request), F.when(html.isNotNull(), row("response", F.concat(F.encode(head, "UTF-8"), body))))
    return pages.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)`` of the responses in the archives at ``path``: requests and the archives' own
    records are passed over by their headers. Repeated records are rows each; a missing id or url is null, an empty
    payload an empty text; archives without responses give no rows."""
    register(spark)
    rows = spark.read.format("warc").schema("type string, uri string, content_type string, headers map<string,string>, body string").load(path)
    rows = rows.where((F.col("type") == "response") & F.col("content_type").startswith("application/http"))
    return rows.select(F.col("headers")["page-id"].cast("bigint").alias("page_id"), F.col("uri").alias("url"), F.col("body").alias("html"))
