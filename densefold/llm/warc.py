"""WARC archives: a Spark data source for reading and writing, and deduplicated archiving of pages.

Method: a Python data source. Planning gives each archive file a partition. Predicates on record type and on the other header columns
are pushed down: a reader parses a record's headers first, and of records that no predicate lets through it doesn't decode the payload.

* Archives of this writer have a gzip member for each record, whose extra field ``sl`` (skip-lengths) holds its compressed and plain size: only
  the headers of unwanted records are inflated, the rest is skipped in the file.
* Other gzip archives, whether they have a member for each record, one for all, or members cut anywhere, are one inflated stream of records. It is inflated
  just far enough to parse a record's headers; an unwanted payload runs through a small buffer and is never put together.
* Plain, uncompressed archives are skipped by Content-Length.

Records are ``response`` (an HTTP head and the payload) or ``revisit`` (the HTTP head alone, with the digest of the payload and the id of the record
that holds it). A writer's task has a file of its own, and only the files of tasks that ended well are named in the manifest that the commit writes;
a reader takes the files of the manifest, or all ``*.warc`` and ``*.warc.gz`` where there is none; a folder without any, or an empty table, gives no rows.

A payload of any length is one value, so it must fit a task as it must fit a row; null payloads are empty. Rows that repeat, ids included, are records
of their own. The source has its own columns; other columns of a table that is archived are ignored, whatever their names. Of equal payloads the
one of the greatest id is the response; equal ids with equal payloads tie, and all of them are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from densefold.llm.common import Scratch, column

SCHEMA = "record_id string, warc_type string, target_uri string, date string, payload_sha1 string, refers_to string, payload_bytes long, payload binary"
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest"
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
HEAD_BYTES = 4096
FLUSH = 8 << 20
#: What is read from a file, and what is inflated, at once.
READ, INFLATED = 1 << 20, 1 << 16

# The format's own texts.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def _place(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


def _id(x: str | None) -> str | None:
    return x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x


def _sha1(digest: str) -> str | None:
    """Hexadecimal form of a SHA-1 digest, which archives hold in base 32 or hexadecimal; null for other digests."""
    kind, _, value = digest.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def record(record_id: str, kind: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record, uncompressed. Line breaks in a URI would end its header, so they are percent-encoded."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind != "revisit":
        block += payload
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block + END


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field holds its compressed and plain size."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Input:
    """A file with a buffer that can be looked into."""

    def __init__(self, stream):
        self.stream, self.held, self.k = stream, b"", 0

    def more(self, n: int) -> bytes:
        return self.stream.read(max(READ, n))

    def peek(self, n: int) -> bytes:
        """The next n bytes, or all that are left."""
        if len(self.held) - self.k < n:
            parts, have = [self.held[self.k :]], len(self.held) - self.k
            while have < n and (more := self.more(n - have)):
                parts.append(more)
                have += len(more)
            self.held, self.k = b"".join(parts), 0
        return self.held[self.k : self.k + n]

    def skip(self, n: int) -> None:
        have = len(self.held) - self.k
        if n <= have:
            self.k += n
        else:
            self.held, self.k = b"", 0
            self.past(n - have)

    def past(self, n: int) -> None:
        self.stream.seek(self.stream.tell() + n)


class _Inflated(_Input):
    """What gzip members hold, one after the other, wherever records begin and end in them."""

    def __init__(self, src: _Input):
        super().__init__(None)
        self.src, self.member = src, None

    def more(self, n: int = INFLATED) -> bytes:
        while True:
            if self.member is None:
                if not self.src.peek(1):
                    return b""
                self.member = zlib.decompressobj(31)
            member, chunk = self.member, self.src.peek(INFLATED)
            out = member.decompress(chunk, max(INFLATED, n))
            self.src.skip(len(chunk) - len(member.unused_data if member.eof else member.unconsumed_tail))
            if member.eof:
                self.member = None
            elif not chunk and not out:
                raise ValueError("gzip member cut short")
            if out:
                return out

    def past(self, n: int) -> None:
        while n > 0:
            out = self.more()
            if not out:
                return
            self.held, self.k = out, min(n, len(out))
            n -= self.k

    def at_member(self) -> bool:
        """Whether everything inflated so far is used up and the next member, if any, is untouched."""
        return self.member is None and self.k == len(self.held)


def _parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _plain_record(src: _Input, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """The record that begins here, if it is wanted; the input then stands behind it."""
    n = HEAD_BYTES
    while (end := (part := src.peek(n)).find(END)) < 0:
        if len(part) < n:
            raise ValueError("record head cut short")
        n *= 2
    fields = _parse_head(part[:end])
    size = int(fields["content-length"])
    src.skip(end + 4)
    if wanted(fields):
        block = src.peek(size if with_payload or fields.get("warc-type") == "revisit" else min(size, HEAD_BYTES))
        if with_payload and len(block) < size:
            raise ValueError("record cut short")
        yield fields, block
    src.skip(size)
    # Two line ends close a record; writers that leave them out, or put in more, are read all the same.
    while (ends := src.peek(4)) and ends[:1] in b"\r\n":
        src.skip(len(ends) - len(ends.lstrip(b"\r\n")))


def records(stream, wanted, with_payload: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose headers ``wanted`` takes. Without payloads a block is cut off after its first bytes, which hold an HTTP head."""
    src = _Input(stream)
    inflated = _Inflated(src)
    while True:
        if inflated.at_member():
            head = src.peek(24)
            if not head:
                return
            if len(head) == 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl":
                size = struct.unpack_from("<I", head, 16)[0]
                part = zlib.decompressobj(31).decompress(src.peek(min(size, HEAD_BYTES)), HEAD_BYTES)
                end = part.find(END)
                if end < 0:
                    part = zlib.decompress(src.peek(size), 31)
                    end = part.index(END)
                fields = _parse_head(part[:end])
                if wanted(fields):
                    whole = zlib.decompress(src.peek(size), 31) if with_payload or fields.get("warc-type") == "revisit" else part
                    yield fields, whole[end + 4 : end + 4 + int(fields["content-length"])]
                src.skip(size)
                continue
            if head[:2] != b"\x1f\x8b":
                yield from _plain_record(src, wanted, with_payload)
                continue
        if not inflated.peek(1):
            return
        yield from _plain_record(inflated, wanted, with_payload)


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of header columns; gives the others back to Spark."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append(("in", name, (f.value,)))
            elif name and isinstance(f, In):
                self.tests.append(("in", name, tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append(("starts", name, f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append(("there", name, None))
            else:
                yield f

    def wanted(self, fields: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            x = _id(fields.get(name))
            if x is None or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        fs, folder = _place(self.path)
        listed = [f.path for f in fs.get_file_info(pfs.FileSelector(folder)) if f.path.endswith((".warc", ".warc.gz"))]
        manifests = [f.path for f in fs.get_file_info(pfs.FileSelector(folder)) if f.path.rsplit("/", 1)[-1].startswith(MANIFEST)]
        if manifests:
            named = {n for m in manifests for n in fs.open_input_stream(m).read().decode().split()}
            listed = [p for p in listed if p.rsplit("/", 1)[-1] in named]
        return [_File(p) for p in sorted(listed)] or [_File("")]  # Spark reads without a partition object where there is none

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        fs, _ = _place(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.value) as stream:
            for fields, block in records(stream, self.wanted, self.with_payload):
                rows.append(self._row(fields, block))
                held += len(block or b"")
                if held > FLUSH or len(rows) >= 5000:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, fields: dict[str, str], block: bytes) -> tuple:
        revisit = fields.get("warc-type") == "revisit"
        payload, size = block, int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            http, end, payload = block.partition(END)
            size -= len(http) + len(end)
            if revisit:
                size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), size)
        sha1 = _sha1(fields.get("warc-payload-digest", ""))
        if self.with_payload and not revisit and sha1 is not None and hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError(f"{fields.get('warc-record-id')}: payload doesn't match its digest")
        return (*(_id(fields.get(h)) for h in list(HEADERS.values())[:4]), sha1, _id(fields.get("warc-refers-to")), size, payload if self.with_payload and not revisit else None)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.string()] * 6, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], self.names)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Rows with record_id, warc_type, target_uri, payload, refers_to."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = _place(self.path)
        name, out, held = f"{uuid.uuid4().hex}.warc.gz", None, []
        try:
            for batch in iterator:
                cols = [column(batch, c).to_pylist() for c in ("record_id", "warc_type", "target_uri", "payload", "refers_to")]
                for i, kind, uri, payload, other in zip(*cols, strict=True):
                    held.append(member(record(i, kind, uri, payload or b"", other, self.date)))
                if held:
                    if out is None:
                        fs.create_dir(folder)
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(b"".join(held))
                    held = []
        finally:
            if out is not None:
                out.close()
        return _Written([name] if out is not None else [])

    def commit(self, messages: list) -> None:
        fs, folder = _place(self.path)
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as out:
            out.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages: list) -> None:
        fs, folder = _place(self.path)
        for m in messages:
            for n in m.names if m else []:
                fs.delete_file(f"{folder}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload`` false leaves payloads undecoded. ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(spark: SparkSession, pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write pages (page_id, url, html) as records: of equal payloads of so many bytes or more the one of the greatest page_id is the response.

    Digests are compared in a shuffle of their own that carries no payload; a payload that very many pages share is one key of a
    map-side combined aggregate. Null html is an empty payload. Rows with a null id are left out;
    rows that repeat an id are records of their own.
    """
    register(spark)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).where("page_id IS NOT NULL")
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    large = rows.where("digest IS NOT NULL").select("page_id", "digest")
    several = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = large.join(several, "digest").where("page_id <> holder").select("page_id", "digest", "holder").distinct()
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    out = rows.join(again, ["page_id", "digest"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(F.col("holder").isNull(), "response").otherwise("revisit").alias("warc_type"), F.col("url").alias("target_uri"), "payload", urn(F.col("holder")).alias("refers_to")
    )
    out.write.format("warc").mode("append").save(path)


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages written to archives in the shared folder and read back, by the columns of the source and page_id."""
    work = Scratch(spark, "warc")
    archive(spark, pages, f"{work.uri}/archives", least)
    read = spark.read.format("warc").load(f"{work.uri}/archives")
    page = lambda c: F.replace(F.col(c), F.lit("urn:page:"), F.lit("")).cast("bigint")
    return read.withColumn("page_id", page("record_id")).withColumn("refers_to", page("refers_to"))
