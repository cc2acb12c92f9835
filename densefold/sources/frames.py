"""Length-framed JSON messages in files: a Spark data source, read and written.

A frame is header lines up to an empty one, among them ``Content-Length`` (in any case), and a body of so many bytes. Reading gives a
row per frame, in file order, with what is wrong with it where it is no message: a bad frame costs itself, not the file.
The writer gives each task a file of its own, and only files of tasks that ended well get a name that readers look at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "session string, frame_no long, id string, method string, params string, error string"
SUFFIX = ".frames"
MAX_BYTES = 64 * 1024 * 1024
BATCH = 8 << 20


def place(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


def frame(body: str) -> bytes:
    data = body.encode()
    return b"Content-Length: %d\r\n\r\n" % len(data) + data


def _lines(stream, held: bytes) -> tuple[list[bytes] | None, bytes]:
    """Header lines up to the empty one, and what was read past it; None at the end of the file."""
    lines: list[bytes] = []
    while True:
        line, newline, rest = held.partition(b"\n")
        if not newline:
            more = stream.read(1 << 16)
            if not more:
                return None, b""
            held += more
            continue
        held = rest
        line = line.rstrip(b"\r")
        if not line:
            return lines, held
        lines.append(line)


def bodies(stream, max_bytes: int = MAX_BYTES) -> Iterator[tuple[bytes | None, str | None]]:
    """(body, error) of each frame. A frame that is too large is skipped as a whole."""
    held = b""
    while True:
        lines, held = _lines(stream, held)
        if lines is None:
            return
        size = None
        for line in lines:
            name, colon, value = line.partition(b":")
            if colon and name.strip().lower() == b"content-length":
                size = int(value) if value.strip().isdigit() else None
        if size is None:
            yield None, "missing Content-Length"
            continue
        too_large, left = size > max_bytes, size
        parts = []
        while left:
            part, held = held[:left], held[left:]
            if not part:
                held = stream.read(1 << 20)
                if not held:
                    yield None, "frame cut short"
                    return
                continue
            left -= len(part)
            if not too_large:
                parts.append(part)
        yield (None, f"frame too large: {size} > {max_bytes}") if too_large else (b"".join(parts), None)


def message(body: bytes | None, error: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(id, method, params, error); id and params as JSON text."""
    if body is None:
        return None, None, None, error
    try:
        m = json.loads(body)
    except (ValueError, RecursionError) as e:
        return None, None, None, f"bad JSON: {type(e).__name__}"
    m = m if isinstance(m, dict) else {}
    text = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace").decode()
    return text(m.get("id")), m["method"] if isinstance(m.get("method"), str) else "", text(m["params"]) if "params" in m else None, None


class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.max_bytes = options["path"], int(options.get("maxbytes", MAX_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        fs, folder = place(self.path)
        found = sorted(f.path for f in fs.get_file_info(pfs.FileSelector(folder)) if f.path.endswith(SUFFIX))
        return [InputPartition(p) for p in found] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        fs, _ = place(self.path)
        name, rows, held = partition.value.rsplit("/", 1)[-1].removesuffix(SUFFIX), [], 0
        with fs.open_input_stream(partition.value) as stream:
            for k, (body, error) in enumerate(bodies(stream, self.max_bytes)):
                rows.append((name, k, *message(body, error)))
                held += len(body or b"")
                if held > BATCH:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), *[pa.string()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["session", "frame_no", "id", "method", "params", "error"])


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class FramesWriter(DataSourceArrowWriter):
    """Rows with one column, ``body``: JSON texts, in order."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = place(self.path)
        name, out = f"{uuid.uuid4().hex}{SUFFIX}", None
        try:
            for batch in iterator:
                data = b"".join(frame(x) for x in batch.column(0).to_pylist() if x is not None)
                if data:
                    if out is None:
                        fs.create_dir(folder)
                        out = fs.open_output_stream(f"{folder}/_{name}.part")
                    out.write(data)
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list) -> None:
        fs, folder = place(self.path)
        fs.create_dir(folder)
        for m in messages:
            if m and m.name:
                fs.move(f"{folder}/_{m.name}.part", f"{folder}/{m.name}")

    def abort(self, messages: list) -> None:
        fs, folder = place(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{folder}/_{m.name}.part")


class FramesSource(DataSource):
    """``spark.read.format("frames").load(folder)`` reads ``*.frames``; ``df.select("body").write.format("frames").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FramesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("frames are only appended")
        return FramesWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramesSource)


def read(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("frames").load(folder)


def write(spark: SparkSession, bodies_: DataFrame, folder: str) -> None:
    register(spark)
    bodies_.select(F.col("body").cast("string").alias("body")).write.format("frames").mode("append").save(folder)
