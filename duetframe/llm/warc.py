"""WARC archives as a PySpark data source, read and written.

``spark.read.format("warc").load(folder)`` plans partitions from the files' sizes and reads header first: predicates on the
record type, the target URI, the record id and the other header columns are taken over from Spark and decided on the
parsed header; the block of an unwanted record is skipped by its length and never decoded. With ``payload=false`` no block
is decoded at all. ``.warc.gz`` files (a gzip member for each record) are read as a stream.

``df.write.format("warc").save(folder)`` writes one file or more for each task (a new one after ``max_file_bytes``). A job
commits by writing ``_MANIFEST`` with the files of the tasks that Spark accepted; readers go by it, so what lost or
repeated tasks left behind is never read. Files are reached through Arrow's file systems (local, S3, GCS, HDFS).

Edge cases: a null payload is written as an empty one, and a null id as ``<urn:page:>``, which reads back as null; header
values lose line breaks; empty tables make a manifest without files, which reads as no rows; a file that ends inside a
record is an error. In ``plan_records`` all rows of the smallest id keep their payload if that id is repeated.
"""

from __future__ import annotations

import gzip
import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import among, materialize

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
#: Column to the WARC header that it shows.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Our own extension header: the length of the full payload, which a revisit record does not hold.
LENGTH = "X-Payload-Length"
MANIFEST = "_MANIFEST"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_AT_ONCE = 1 << 20
#: Rows and payload bytes of an Arrow batch, about.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
SMALLEST_REVISIT = 100


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Plain:
    """A file read in large pieces; what is skipped and not yet read is jumped over."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.at, self.buf = file, file.size(), 0, 0, b""

    def peek(self, n: int) -> bytes:
        if self.at + n > len(self.buf):
            self.base, self.at = self.base + self.at, 0
            self.file.seek(min(self.base, self.size))
            self.buf = self.file.read(max(n, READ_AT_ONCE))
        return self.buf[self.at:self.at + n]

    def skip(self, n: int) -> None:
        self.at += n
        if self.base + self.at > self.size:
            raise EOFError("the archive ends inside a record")


class _Stream:
    """The same over a decompressing stream, where skipping discards."""

    def __init__(self, file: io.BufferedIOBase):
        self.file, self.buf = file, b""

    def peek(self, n: int) -> bytes:
        while len(self.buf) < n and (more := self.file.read(max(n - len(self.buf), 65_536))):
            self.buf += more
        return self.buf[:n]

    def skip(self, n: int) -> None:
        while n > len(self.buf):
            n -= len(self.buf)
            if not (more := self.file.read(READ_AT_ONCE)):
                raise EOFError("the archive ends inside a record")
            self.buf = more
        self.buf = self.buf[n:]


def _take(source: _Plain | _Stream, n: int) -> bytes:
    out = source.peek(n)
    source.skip(n)
    return out


def _header(source: _Plain | _Stream) -> dict[str, str] | None:
    """The next record's header fields; None at the end."""
    n = 4_096
    while True:
        got = source.peek(n)
        if not got.strip(b"\r\n"):
            if len(got) < n:
                return None
            source.skip(len(got))
            continue
        end = got.find(b"\r\n\r\n", len(got) - len(got.lstrip(b"\r\n")))
        if end >= 0:
            break
        if len(got) < n:
            raise EOFError("the archive ends inside a header")
        n *= 2
    source.skip(end + 4)
    version, *lines = got[:end].decode("utf-8", "replace").strip().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _payload(block: bytes, content_type: str) -> bytes:
    """A record's payload: for HTTP messages, the body without its encodings."""
    if not content_type.startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        whole, rest = b"", body
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            n = int(size.split(b";")[0], 16)
            whole, rest = whole + rest[:n], rest[n + 2:]
            if not n:
                break
        body = whole
    coding = fields.get(b"content-encoding")
    return zlib.decompress(body, 47) if coding in (b"gzip", b"deflate", b"x-gzip") and body else body


def records(source: _Plain | _Stream, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose header fields ``wanted`` accepts."""
    while (head := _header(source)) is not None:
        length = int(head["Content-Length"])
        row = {c: head.get(h) for c, h in HEADERS.items()}
        if not wanted(row):
            source.skip(length)
            continue
        if payload:
            body = _payload(_take(source, length), row["content_type"] or "")
        else:
            source.skip(length)
            body = None
        n = head.get(LENGTH)
        yield (*row.values(), n and int(n), body, head)


@dataclass
class Files(InputPartition):
    """The files of one task."""

    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    """Plans by file size; decides what it was given of the predicates on headers."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "some", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        found, base = _open(self.path)
        infos = found.get_file_info(fs.FileSelector(base, recursive=True)) if found.get_file_info(base).type == fs.FileType.Directory else [found.get_file_info(base)]
        sizes = {i.path: i.size for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz"))}
        if any(i.path.endswith(f"/{MANIFEST}") for i in infos):
            listed = json.loads(found.open_input_stream(f"{base}/{MANIFEST}").read())
            sizes = {p: sizes[p] for p in (f"{base}/{x}" for x in listed)}
        out, size = [[]], 0
        for p in sorted(sizes):
            if out[-1] and size + sizes[p] > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(p)
            size += sizes[p]
        return [Files(tuple(x)) for x in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests, (found, _) = self.tests, _open(self.path)

        def wanted(row: dict) -> bool:
            for column, kind, value in tests:
                x = row[column]
                if x is None or kind == "in" and x not in value or kind == "prefix" and not x.startswith(value):
                    return False
            return True

        kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
        names = [*HEADERS, "payload_bytes", "payload", "headers"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([list(v.items()) for v in c] if n == "headers" else c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)]
            made = dict(zip(names, cols, strict=True))
            order = [x.split()[0] for x in SCHEMA.replace("<string,string>", "").split(", ")]
            return pa.RecordBatch.from_arrays([made[n] for n in order], order)

        rows, size = [], 0
        for path in partition.paths:
            if path.endswith(".gz"):
                source = _Stream(gzip.GzipFile(fileobj=found.open_input_stream(path, compression=None)))
            else:
                source = _Plain(found.open_input_file(path))
            for row in records(source, wanted, self.payload):
                rows.append(row)
                size += len(row[-2] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task that ended well."""

    files: list[str]


def _field(value: object) -> str:
    return "" if value is None else str(value).replace("\r", " ").replace("\n", " ")


def encode_record(record_type: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """A record: a response with its payload gzipped as HTTP content, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "response":
        body = gzip.compress(payload, 4, mtime=0)
        block = http + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    else:
        block = http + b"\r\n"
    head = {"WARC-Type": record_type, "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{digest}", LENGTH: length, "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        head |= {"WARC-Refers-To": refers_to, "WARC-Profile": IDENTICAL}
    lines = "".join(f"{k}: {_field(v)}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Rows of ``plan_records`` to files; one manifest at the end."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("warc_date", "1970-01-01T00:00:00Z")
        self.max_file_bytes = int(options.get("max_file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from uuid import uuid4

        found, base = _open(self.path)
        found.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size >= self.max_file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid4().hex}.warc")
                    out, size = found.open_output_stream(f"{base}/{files[-1]}"), 0
                    info = b"software: duetframe\r\nformat: WARC File Format 1.1\r\n"
                    size += out.write(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{files[-1]}>\r\nWARC-Date: {self.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                size += out.write(encode_record(r["record_type"], r["record_id"], r["target_uri"], self.date, r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"]))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        found, base = _open(self.path)
        found.create_dir(base, recursive=True)
        with found.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        found, base = _open(self.path)
        for f in (f for m in messages if m for f in m.files):
            found.delete_file(f"{base}/{f}")


class WarcDataSource(DataSource):
    """``format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(record) -> F.Column:
    return F.nullif(F.regexp_extract(record, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """The records to write: of equal payloads of at least ``smallest`` bytes, that of the smallest id is the response.

    Digests are grouped first, without the pages, and only pages whose digest may repeat move to meet them; a digest that
    very many pages share is one row there, and the join's page side can be split.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("payload")).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    firsts = materialize(firsts, "warc-firsts")
    h = F.xxhash64("payload_digest")
    repeats = (F.col("payload_bytes") >= smallest) & among(firsts.select(h.alias("h")))(h)
    joined = rows.where(repeats).join(firsts, "payload_digest", "left").unionByName(rows.where(~repeats).withColumn("first", F.lit(None).cast("long")))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return joined.select(
        record_id(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(~again, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", F.when(again, record_id(F.col("first"))).alias("refers_to"))


def archive(pages: DataFrame, path: str, **columns) -> None:
    """Write ``pages`` as WARC files to a new folder that all executors reach."""
    register(pages.sparkSession)
    plan_records(pages, **columns).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
