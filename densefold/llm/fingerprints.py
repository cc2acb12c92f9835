"""Fingerprints of texts for positional matching.

Method: closed syncmers. Of all runs of K code points those are anchors whose least inner run of S (by hash) lies at one of
the two edges. Whether a run is an anchor depends on its own code points alone, so an edit elsewhere neither adds nor removes
anchors, and every stretch of unchanged text keeps its own. A fingerprint holds all anchors of a text, with the position of the first occurrence
of each, so it grows with the text (some 2 anchors for 9 code points) and nothing is estimated.

Likeness of two fingerprints: of the anchors of both together, the share that both have and that follow each other in the same order in
both: the longest such chain, whatever the shifts in position along it, so text put in or taken out costs its own anchors only. That is the
Jaccard similarity of the anchor sets, less anchors that only match out of place. Two empty
fingerprints are alike (1.0); an empty and another one are not (0.0).

As a string: 16 hexadecimal digits an anchor, 8 of its hash and 8 of its position, in order of hash; a position always fits, as no value of Spark's holds
2^32 code points. A text shorter than K code points but not empty has one anchor, the hash of the whole; the empty text and null have the empty
string. Equal texts have equal fingerprints. Long texts are worked on as a whole, some 100 bytes of memory for a code point.

Rows with a null id are left out. Rows that repeat an id are documents of their own: of equal ids the one of the lesser text comes next, and rows that tie in both
are alike, so their order doesn't matter. An empty table gives an empty table. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densefold.llm.common import column, id_text, n_buckets, texts

K, S = 12, 4
DIGITS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_R = {m: np.uint64(pow(0x5851F42D4C957F2D, m, 1 << 64)) for m in (1, 2, 4)}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all closed syncmers, in order of position; hashes have 32 bits."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(c) - K + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 32], np.uint64), np.zeros(1, np.int64)
    # Hashes of runs by doubling: h(m + k)[i] = h(m)[i] * r^k + h(k)[i + m].
    h1 = _mixed((c + np.uint64(1)) * _ODD)
    h2 = h1[:-1] * _R[1] + h1[1:]
    h4 = h2[:-2] * _R[2] + h2[2:]
    h8 = h4[:-4] * _R[4] + h4[4:]
    whole = h8[:-4] * _R[4] + h4[8:]
    inner = _mixed(h4)
    # Least of the K - S + 1 = 9 inner runs.
    m2 = np.minimum(inner[:-1], inner[1:])
    m4 = np.minimum(m2[:-2], m2[2:])
    m8 = np.minimum(m4[:-4], m4[4:])
    least = np.minimum(m8[:-1], m8[1:])
    at = np.flatnonzero((inner[:n] == least) | (inner[K - S : K - S + n] == least))
    if not len(at):
        at = np.zeros(1, np.int64)
    return _mixed(whole[at]) >> np.uint64(32), at


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the position of each one's first occurrence."""
    h, p = anchors(text)
    u, first = np.unique(h, return_index=True)
    return u, p[first]


def as_bytes(f: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Eight bytes an anchor: four of its hash, four of its position."""
    both = np.empty((len(f[0]), 2), ">u4")
    both[:, 0], both[:, 1] = f
    return both.tobytes()


def as_text(f: tuple[np.ndarray, np.ndarray]) -> str:
    return as_bytes(f).hex()


def from_text(s: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bytes.fromhex(s), ">u4").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.int64)


def _in_order(p: np.ndarray, q: np.ndarray) -> int:
    """Most pairs (p, q) of which none goes back in either."""
    q = q[np.lexsort((q, p))]
    if (q[1:] >= q[:-1]).all():
        return len(q)
    ends: list[int] = []  # least end of a chain of each length
    for x in q.tolist():
        k = bisect_right(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; symmetric."""
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    both, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    return _in_order(pa_[i], pb[j]) / (len(ha) + len(hb) - len(both))


COLS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
DEALT = "bucket int, doc_id long, text string"
#: Bytes of fingerprints that a task holds before it hands them on.
HELD = 16 << 20


def edited(text: str, following: str) -> str:
    """The text with its second half (rounded down) replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc: int, text: str, mine, following: str, its) -> tuple:
    e = edited(text, following)
    fe = fingerprint(e)
    return doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest(), as_bytes(mine), as_bytes(fe), likeness(mine, fe), likeness(mine, its)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLS.values(), strict=True)], list(COLS))


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + len(row[4])
        if size > HELD or len(held) == 10_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents of a partition but its last, whose next one is elsewhere."""

    def rows() -> Iterator[tuple]:
        held = None
        for batch in batches:
            for doc, text in texts(batch):
                text = text or ""
                mine = fingerprint(text)
                if held is not None:
                    yield _row(*held, text, mine)
                held = (doc, text, mine)

    return _in_batches(rows())


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are missing: the last document of each bucket with the first text of the next one."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, text, following in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                yield _row(doc, text, fingerprint(text), following, fingerprint(following))

    return _in_batches(rows())


def _deal(bounds: np.ndarray):
    """Each row's bucket: ranges of doc_id, the greatest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = len(bounds) - np.searchsorted(bounds, column(batch, "doc_id").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *batch.columns], ["bucket", *batch.schema.names])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, size = [], [], 0
            for doc, t in texts(batch):
                ids.append(doc)
                found.append(as_text(fingerprint(t)))
                size += len(found[-1])
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"])
                    ids, found, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to that and to the next document's.

    The next document is the one of the next smaller doc_id, and for the smallest the greatest (of equal ids, the one of the lesser
    text is next). Texts are shuffled once, into ranges of doc_id; each partition is then one pass in order. The ranges are fixed
    beforehand, so the least and greatest id of each is known: those few texts are read again, and the two on either side of each border
    meet in a row of their own, on as many tasks as there are borders. Fingerprints, which may exceed the texts, go straight to the result.
    """
    n, given = n_buckets(spark, docs), id_text(docs)
    (cuts,) = given.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first() if n > 1 else ([],)
    deal = _deal(np.unique(np.array(cuts or [], np.int64)))
    # One row a bucket: its least id, and the greatest of the next bucket that isn't empty (behind the last: of the first).
    ids = given.select("doc_id").mapInArrow(deal, "bucket int, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    order = Window.orderBy("bucket")
    borders = ids.select("bucket", "least", F.coalesce(F.lead("most").over(order), F.max("most").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("most"))
    sides = borders.select("bucket", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("least").alias("doc_id")), F.struct(F.lit(False).alias("own"), F.col("most").alias("doc_id")))).alias("side"))
    # Broadcast: two rows of two numbers for each of the n buckets, whatever the input.
    read = given.join(F.broadcast(sides.select("bucket", "side.*")), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    ends = read.groupBy("bucket").agg(F.min(F.when(F.col("own"), F.col("doc_id"))).alias("doc_id"), F.min(F.when(F.col("own"), F.col("text"))).alias("text"), F.max(F.when(~F.col("own"), F.col("text"))).alias("following"))
    ends = ends.select("doc_id", "text", "following").mapInArrow(_edges, SCHEMA)
    dealt = given.mapInArrow(deal, DEALT).repartitionById(n, F.col("bucket")).sortWithinPartitions(F.desc("doc_id"), F.desc("text"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    out = dealt.mapInArrow(_neighbours, SCHEMA).unionByName(ends)
    return out.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
