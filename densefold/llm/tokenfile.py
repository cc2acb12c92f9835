"""Token ids in files of framed records, with a separate offset index.

Method: length-delimited binary records. Each document is one record

    length (uint64) | masked CRC-32 of the length (uint32) | payload | masked CRC-32 of the payload (uint32)

little-endian throughout; the payload is the document's id (int64), the bytes an id takes (uint8: 2 if all ids of the vocabulary fit, else 4)
and the document's token ids. A mask turns the
checksum by 15 bits and adds a constant, so that checksums of data that hold checksums stay good. Files go in ascending
doc_id order, one for each range of ids. The index, a Parquet table, has file, offset and length of every
record, for reads in any order. Files and index lie in a folder of the caller's, which stays, or else in one that goes with the session.

A task writes to a file of its own name and the index names the files of the tasks that ended well: a
task that runs again leaves a file that nothing names. Null texts count as empty and hold the end id alone; a text of any length is one record.
Rows with a null id are left out. Rows that repeat an id are records of their own, side by side in no particular order, the only tie there is. An empty table gives an index
without rows and no files. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densefold.llm.bpe import vocabulary, whole_encoder
from densefold.llm.common import Scratch, column, id_text, n_buckets, texts

# The mask of the framing's checksums.
MASK = 0xA282EAD8
READ_BYTES = 8 << 20
INDEX = "shard int, file string, doc_id long, offset long, length long, n_tokens long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked_crc(head)), data, struct.pack("<I", masked_crc(data))))


def records(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of a file; a bad checksum or a cut record is an error."""
    held, at = b"", 0

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = stream.read(max(READ_BYTES, n - len(held)))
            if not more:
                return False
            held += more
        return True

    k = 0
    while need(k + 12):
        size, crc = struct.unpack_from("<QI", held, k)
        if masked_crc(held[k : k + 8]) != crc:
            raise ValueError(f"record at {at}: bad checksum of the length")
        if not need(k + 16 + size):
            raise ValueError(f"record at {at}: cut short")
        data = held[k + 12 : k + 12 + size]
        if masked_crc(data) != struct.unpack_from("<I", held, k + 12 + size)[0]:
            raise ValueError(f"record at {at}: bad checksum of the payload")
        yield at, data
        at += 16 + size
        k += 16 + size
        if k > READ_BYTES:
            held, k = held[k:], 0
    if len(held) > k:
        raise ValueError(f"record at {at}: cut short")


def payload(doc: int, ids: bytes, width: int) -> bytes:
    """Payload of 32-bit ids, stored at the given width."""
    return struct.pack("<qB", doc, width) + (ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())


def unpacked(data: bytes) -> tuple[int, bytes]:
    """(doc_id, 32-bit ids) of a payload."""
    doc, width = struct.unpack_from("<qB", data)
    return doc, data[9:] if width == 4 else np.frombuffer(data, "<u2", offset=9).astype("<u4").tobytes()


def _write(uri: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = whole_encoder(path).encode, struct.pack("<I", end_id)
        width = 2 if max(end_id, *vocabulary(path).bytes) < 65536 else 4
        fs, folder = pfs.FileSystem.from_uri(uri)
        context = TaskContext.get()
        shard, out, at = context.partitionId(), None, 0
        name = f"shard-{shard:06d}-{context.taskAttemptId()}.rec"
        try:
            for batch in batches:
                rows, framed = [], []
                for doc, text in texts(batch):
                    ids = encode(text) + end
                    data = frame(payload(doc, ids, width))
                    rows.append((doc, at, len(data), len(ids) // 4))
                    framed.append(data)
                    at += len(data)
                if rows:
                    out = out or fs.open_output_stream(f"{folder}/{name}")
                    out.write(b"".join(framed))
                    d, o, k, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array([name] * len(rows)), *(pa.array(x, pa.int64()) for x in (d, o, k, n))], ["shard", "file", "doc_id", "offset", "length", "n_tokens"])
        finally:
            if out:
                out.close()

    return run


def write(spark: SparkSession, docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Write all documents and their index to a new folder (a full URI or a path that all machines share); returns the folder."""
    if folder is None:
        folder = Scratch(spark, "tokens").uri
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        folder = fs.makeQualified(place).toString()
    ordered = id_text(docs).repartitionByRange(n_buckets(spark, docs), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_write(folder, path, end_id), INDEX).write.parquet(f"{folder}/index")
    return folder


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, file, doc_id, offset, length, n_tokens) of every record."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pfs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, start in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist(), strict=True):
                rows: list[tuple[int, int, bytes]] = []
                held = 0
                with fs.open_input_stream(f"{folder}/{name}") as stream:
                    for _, data in records(stream):
                        doc, ids = unpacked(data)
                        rows.append((doc, start, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > READ_BYTES:
                            yield _read_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _read_batch(rows)

    return run


def _read_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    doc, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every record, from the files: start counts the tokens of all documents before. One task a file."""
    files = index(spark, folder).groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # over one row a file
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("start"), (F.row_number().over(Window.orderBy("shard")) - 1).alias("place"))
    dealt = starts.repartitionById(n_buckets(spark, index(spark, folder)), "place")
    return dealt.mapInArrow(_read(folder), "doc_id long, start long, ids binary")


def _fetch(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pfs.FileSystem.from_uri(uri)
        name, stream = None, None
        for batch in batches:
            ids = []
            for file, offset, length in zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, stream = file, fs.open_input_file(f"{folder}/{file}")
                stream.seek(offset)
                ((_, data),) = records(pa.BufferReader(stream.read(length)))
                ids.append(unpacked(data)[1])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def fetch(folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of chosen rows of the index, read at their offsets."""
    ordered = wanted.repartition("file").sortWithinPartitions("file", "offset")
    return ordered.select("doc_id", "file", "offset", "length").mapInArrow(_fetch(folder), "doc_id long, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, start, ids)."""
    return read_back.select("doc_id", "start", F.octet_length("ids").cast("long").alias("bytes"), F.crc32("ids").alias("ids_crc32")).select("doc_id", "start", F.expr("bytes div 4").alias("n_tokens"), "ids_crc32")
