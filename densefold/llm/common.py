"""What the operators share: written steps in the shared folder, packed rows, and components of links."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting that deletes the shuffle files of an execution when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch while a step is written, where the session sets none: the JVM and the worker hold a batch or two each, for every task that runs.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: Bytes of (compressed) input a bucket should stand for: what a task sorts in memory is some ten times that at most.
BUCKET_BYTES = 32 << 20


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="densefold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written between the steps of one operator call.

    A step that is written needn't run again when an executor is lost. Steps that no later one needs go at once with drop(); the folder goes
    with close(), with clean() once the results of all calls are taken, or when the application ends.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._root)
        self._fs.deleteOnExit(self._root)
        #: As executors reach it, with its scheme.
        self.uri = self._fs.makeQualified(self._root).toString()
        Scratch._open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a step and read it back. The shuffle files that it needed go as soon as it is written."""
        before = {k: self.spark.conf.get(k, None) for k in (FREE_SHUFFLES, BATCH)}
        during = {FREE_SHUFFLES: "true", BATCH: before[BATCH] or str(BATCH_BYTES)}
        try:
            for k, v in during.items():
                self.spark.conf.set(k, v)
            df.write.parquet(f"{self.path}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def close(self) -> None:
        """Delete the folder; tables read from it can't be used any more."""
        self._fs.delete(self._root, True)
        if self in Scratch._open:
            Scratch._open.remove(self)


def clean(spark: SparkSession) -> None:
    """Delete the steps of all calls so far, for sessions that live long. Results must have been written or collected."""
    for work in [w for w in Scratch._open if w.spark is spark]:
        work.close()


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a plan reads, as Spark's statistics have it; 0 where they don't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def n_buckets(spark: SparkSession, df: DataFrame) -> int:
    """Into how many partitions packed rows are dealt: spark.sql.shuffle.partitions, and more where the input needs them, as a bucket is sorted in memory."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BUCKET_BYTES))


PACKED = "bucket int, kind int, blob binary"


def packed(rows: np.ndarray, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row per bucket that holds all its records as bytes, so that the JVM moves blocks and not single records."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(rows)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "kind", "blob"]
    )


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[int, str | None]]:
    return zip(column(batch, id_col).to_pylist(), column(batch, text_col).to_pylist(), strict=True)


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; other columns, of whatever name, aren't touched."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def components(work: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, component): the least id that each linked id reaches. links: (a, b), in any direction, repeated or not.

    Each round points every node to its least neighbour, follows the pointers to their ends, and goes on
    with the links between those ends. Nodes at least halve each round, and every step is written.
    A node with very many links is one key of an aggregate that combines on the map side, and of joins
    whose large partitions Spark splits.
    """
    edges = work.save(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-e0")
    found, r = None, 0
    while not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("root"))
        near, jump = work.save(near, f"{name}-p{r}.0"), 0
        while True:
            up = near.select(F.col("id").alias("root"), F.col("root").alias("top"))
            if near.join(up, "root").where("top <> root").isEmpty():
                break
            jump += 1
            near = work.save(near.join(up, "root").select("id", F.col("top").alias("root")), f"{name}-p{r}.{jump}")
        if found is None:
            found = near
        else:
            moved = near.select(F.col("id").alias("root"), F.col("root").alias("top"))
            found = work.save(found.join(moved, "root", "left").select("id", F.coalesce("top", "root").alias("root")), f"{name}-f{r}")
        u, v = near.select(F.col("id").alias("u"), F.col("root").alias("ru")), near.select(F.col("id").alias("v"), F.col("root").alias("rv"))
        met = edges.join(u, "u").join(v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        r += 1
        edges = work.save(met, f"{name}-e{r}")
    if found is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.select("id", F.col("root").alias("component"))
