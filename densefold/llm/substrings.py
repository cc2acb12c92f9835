"""Removal of long byte strings that an earlier document holds too.

A byte of a document goes when a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Matches never
cross documents; what is judged is the input, not what other removals leave.

Method: depth-limited radix sort of suffixes. Suffixes are ordered through their first ``length`` bytes only, by most-significant-digit
passes, and groups that are equal to that depth are exactly the repeated windows. The first digit is the window's anchor: the run of ``length - span + 1``
bytes of least hash in it, leftmost among equals. Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs,
so that dealing by anchor sends one record for some ``span / 2`` suffixes.

1. Anchors. Each task sends the anchors of its texts, 16 bytes each; the least and greatest document of each anchor decide whether two
   documents hold it. Windows of other anchors can't be repeated.
2. Windows. The anchors that are left send the bytes around them once. Within an anchor's group the windows are ordered by an 8-byte
   fingerprint of their bytes as the next digit, then by the bytes themselves, 8 at a time, wherever equal fingerprints hide different bytes.
   The least document of each equal group keeps its window; the same windows of others are repeated.
3. The covered bytes are cut from the texts.

Of equal whole texts within a task only the one of the least id takes part; the others are known to go from end to end. The same holds of parts:
an anchor that two documents of a task hold is known to be shared, so one record of it is sent; and of anchors whose windows are all equal
only those of the task's least document are sent, as the others' windows are known to be repeated. So the group of a passage that all documents hold
has some records per task, not one per document. Records travel in blocks; a group whose windows differ (a short string in ever new
surroundings) has a record for each document and is worked off in chunks of bounded bytes in order of doc_id against the windows seen so far, so what it holds
grows with the different windows, not with the documents.

Null texts count as empty. Rows with a null id are left out. Rows that repeat an id and its text give as many equal results; an id must not have
two texts. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densefold.llm.common import PACKED, Scratch, column, id_text, n_buckets, packed, texts

#: Records that a task holds before it sends them.
HELD = 400_000
#: Bytes of windows that are ordered at once.
CHUNK = 16 << 20
ANCHOR = np.dtype([("hash", "<u4"), ("pos", "<i4"), ("doc", "<i8")])
PLACE = np.dtype([("doc", "<i8"), ("pos", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
#: Place that stands for a whole text.
WHOLE = -1
_ZSTD = pa.Codec("zstd", 1)
_POS = np.uint64((1 << 24) - 1)
#: Bytes of a text that are looked at at once; longer texts are done in overlapping parts.
PART = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _run_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of so many bytes, by doubling: h(m + k)[i] = h(m)[i] * r^k + h(k)[i + m]."""
    r = 0x5851F42D4C957F2D
    power = {1: r}
    level = {1: (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
    k = 1
    while 2 * k <= size:
        h = level[k]
        level[2 * k] = h[:-k] * np.uint64(power[k]) + h[k:]
        power[2 * k] = power[k] * power[k] & 0xFFFFFFFFFFFFFFFF
        k *= 2
    done, out = 0, None
    for k in sorted(level, reverse=True):
        if size - done >= k:
            n = len(b) - size + 1
            piece = level[k][done : done + n]
            out = piece if out is None else out * np.uint64(power[k]) + piece
            done += k
    return _mixed(out)


def _least_of(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of span values."""
    k = 1
    while 2 * k <= span:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (span - k)], x[span - k :]) if span > k else x


def anchor_runs(text: bytes, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, 64-bit hash, first window, last window) of each anchor, in order. A text's windows are its positions 0 to len - length."""
    size = length - span + 1
    found = []
    for start in range(0, max(1, len(text) - length + 1), PART):
        b = np.frombuffer(text, np.uint8)[start : start + PART + length - 1]
        if len(b) < length:
            break
        h = _run_hashes(b, size)
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        at = (_least_of(key, span) & _POS).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        at = at[first]
        found.append((at + start, _mixed(h[at]), first + start, last + start))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (doc ^ (doc >> 7)) % buckets


def _anchor_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """From the bits of the hash that the record doesn't hold: the more buckets, the more bits tell anchors apart."""
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


class _Sender:
    """Collects records and gives them away as packed rows, compressed if they are mostly text."""

    def __init__(self, kind: int, squeeze: bool = False):
        self.kind, self.squeeze, self.rows, self.buckets, self.n = kind, squeeze, [], [], 0

    def add(self, rows: np.ndarray, bucket: np.ndarray) -> None:
        self.rows.append(rows)
        self.buckets.append(bucket)
        self.n += rows.nbytes

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """The records so far and their buckets, which are held no more."""
        got = np.concatenate(self.rows), np.concatenate(self.buckets)
        self.rows, self.buckets, self.n = [], [], 0
        return got

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.n >= least:
            batch = packed(np.concatenate(self.rows), np.concatenate(self.buckets), self.kind)
            if self.squeeze:
                blobs = [struct.pack("<q", len(x)) + _ZSTD.compress(x, asbytes=True) for x in column(batch, "blob").to_pylist()]
                batch = batch.set_column(batch.schema.get_field_index("blob"), "blob", pa.array(blobs, pa.binary()))
            yield batch
            self.rows, self.buckets, self.n = [], [], 0


def _send_anchors(length: int, span: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        sender, copies = _Sender(0), _Sender(1)

        def shared_here() -> None:
            """Anchors that several documents of this task hold: their places are known, and one record tells the other tasks."""
            if not sender.n:
                return
            rows, bucket = sender.held()
            key = rows["hash"].astype(np.uint64) << np.uint64(32) | bucket.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], rows["doc"][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            several = np.repeat(several, np.diff(np.r_[first, len(key)]))
            places = np.empty(int(several.sum()), PLACE)
            places["doc"], places["pos"] = doc[several], rows["pos"][order][several]
            if len(places):
                copies.add(places, _bucket(places["doc"], buckets))
            several[first] = False
            chosen = order[~several]
            sender.add(rows[chosen], bucket[chosen])

        for batch in batches:
            for doc, text in texts(batch):
                b = _bytes(text)
                if len(b) < length:
                    continue
                digest = xxhash.xxh3_128_digest(b)
                other = least.get(digest)
                least[digest] = doc if other is None else min(doc, other)
                if other == doc:  # the same row once more
                    continue
                if other is not None:  # the greater one of two equal texts is repeated from end to end
                    place = np.array([(max(doc, other), WHOLE)], PLACE)
                    copies.add(place, _bucket(place["doc"], buckets))
                    if doc > other:
                        continue
                at, h, _, _ = anchor_runs(b, length, span)
                rows = np.empty(len(at), ANCHOR)
                rows["hash"], rows["pos"], rows["doc"] = h >> np.uint64(32), at, doc
                sender.add(rows, _anchor_bucket(h, buckets))
            if sender.n >= HELD * ANCHOR.itemsize:
                shared_here()
                yield from sender.out()
            yield from copies.out(HELD * PLACE.itemsize)
        shared_here()
        yield from sender.out()
        yield from copies.out()

    return run


def _plain(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[8:], struct.unpack_from("<q", blob)[0], asbytes=True)


def _blobs(batches: Iterator[pa.RecordBatch], dtype: np.dtype, passed: list[pa.RecordBatch], squeezed: bool = False) -> np.ndarray:
    """The records of kind 0; rows of kind 1, which go on as they are, are added to passed."""
    got = []
    for batch in batches:
        own = column(batch, "kind").to_numpy() == 0
        got += [np.frombuffer(_plain(blob) if squeezed else blob, dtype) for blob in column(batch.filter(pa.array(own)), "blob").to_pylist()]
        if not own.all():
            passed.append(batch.filter(pa.array(~own)))
    return np.concatenate(got) if got else np.zeros(0, dtype)


def _shared_anchors(buckets: int):
    """Places of the anchors that more than one document holds, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        a = _blobs(batches, ANCHOR, passed)
        for batch in passed:  # places that are known, from here on like the others
            yield batch.set_column(batch.schema.get_field_index("kind"), "kind", pa.array(np.zeros(batch.num_rows, np.int32)))
        if not len(a):
            return
        order = np.argsort(a["hash"], kind="stable")
        a = a[order]
        first = np.flatnonzero(np.r_[True, a["hash"][1:] != a["hash"][:-1]])
        several = np.minimum.reduceat(a["doc"], first) != np.maximum.reduceat(a["doc"], first)
        a = a[np.repeat(several, np.diff(np.r_[first, len(a)]))]
        sender = _Sender(0)
        rows = np.empty(len(a), PLACE)
        rows["doc"], rows["pos"] = a["doc"], a["pos"]
        sender.add(rows, _bucket(rows["doc"], buckets))
        yield from sender.out()

    return run


def _by_document(records: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(records["doc"], kind="stable")
    records = records[order]
    first = np.flatnonzero(np.r_[True, records["doc"][1:] != records["doc"][:-1]]) if len(records) else np.zeros(0, np.int64)
    return {int(part["doc"][0]): part for part in np.split(records, first[1:])} if len(records) else {}


def _records_then_texts(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[dict[int, np.ndarray], pa.RecordBatch]]:
    """Each batch of texts, after all records of the partition have come (they sort first)."""
    got, by = [], None
    for batch in batches:
        is_text = column(batch, "kind").to_numpy() == 1
        if not is_text.all():
            got += [np.frombuffer(x.as_buffer(), dtype) for x in column(batch.filter(pa.array(~is_text)), "blob")]
        if is_text.any():
            if by is None:
                by = _by_document(np.concatenate(got) if got else np.zeros(0, dtype))
                got = []
            yield by, batch.filter(pa.array(is_text))


def _window_dtype(length: int, span: int) -> np.dtype:
    """An anchor with its windows (lo to hi: how far left of the anchor they start) and the bytes that those windows cover."""
    return np.dtype([("hash", "<u4"), ("pos", "<i4"), ("doc", "<i8"), ("lo", "<i2"), ("hi", "<i2"), ("bytes", "V", length + span - 1)])


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans, joined where those of a document meet. Of a document, one that starts later doesn't end sooner."""
    o = np.lexsort((end, start, doc))
    doc, start, end = doc[o], start[o], end[o]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    out = np.empty(len(new), SPAN)
    out["doc"], out["start"], out["end"] = doc[new], start[new], end[np.r_[new[1:], len(doc)] - 1]
    return out


def _equal_to_lesser(rows: np.ndarray) -> np.ndarray:
    """Which anchors have all windows in common with one of a lesser document here."""
    flat = np.ascontiguousarray(rows["bytes"]).view(np.uint8).reshape(len(rows), -1)
    words = np.zeros((len(rows), -(-flat.shape[1] // 8) * 8), np.uint8)
    words[:, : flat.shape[1]] = flat
    words = words.view("<u8")
    around = rows["lo"].astype(np.int64) << 16 | rows["hi"]
    order = np.lexsort((rows["doc"], _finger(words) ^ rows["hash"]))
    around, words, doc = around[order], words[order], rows["doc"][order]
    # Equal fingerprints of different bytes at most part a group, which sends more than it need.
    first = np.flatnonzero(np.r_[True, (around[1:] != around[:-1]) | (words[1:] != words[:-1]).any(axis=1)])
    again = np.empty(len(rows), bool)
    again[order] = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(rows)]))
    return again


def _send_windows(length: int, span: int, buckets: int):
    dtype, wide = _window_dtype(length, span), length + span - 1

    place = np.arange(wide, dtype=np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, whole = _Sender(0, squeeze=True), _Sender(1)

        def repeated_here() -> None:
            if not sender.n:
                return
            rows, bucket = sender.held()
            again = _equal_to_lesser(rows)
            if again.any():
                gone = rows[again]
                spans = _merged(gone["doc"], gone["pos"] - gone["hi"], gone["pos"] - gone["lo"] + length)
                whole.add(spans, _bucket(spans["doc"], buckets))
                rows, bucket = rows[~again], bucket[~again]
            sender.add(rows, bucket)

        for by, batch in _records_then_texts(batches, PLACE):
            for doc, text in texts(batch):
                mine = by.get(doc)
                if mine is None:
                    continue
                b = _bytes(text)
                if (mine["pos"] == WHOLE).any():
                    one = np.array([(doc, 0, len(b))], SPAN)
                    whole.add(one, _bucket(one["doc"], buckets))
                    continue
                at, h, first, last = anchor_runs(b, length, span)
                chosen = np.isin(at, mine["pos"])
                at, h, first, last = at[chosen], h[chosen], first[chosen], last[chosen]
                if not len(at):
                    continue
                padded = np.concatenate([np.zeros(span, np.uint8), np.frombuffer(b, np.uint8), np.zeros(wide, np.uint8)])
                rows = np.empty(len(at), dtype)
                rows["hash"], rows["pos"], rows["doc"], rows["lo"], rows["hi"] = h >> np.uint64(32), at, doc, at - last, at - first
                # From span - 1 bytes left of the anchor to as many past the last window; bytes that none of its windows covers are blanked.
                around = np.lib.stride_tricks.sliding_window_view(padded, wide)[at + 1]
                covers = (place >= (span - 1 - rows["hi"])[:, None]) & (place < (span - 1 - rows["lo"] + length)[:, None])
                rows["bytes"] = np.ascontiguousarray(around * covers).view(f"V{wide}").ravel()
                sender.add(rows, _anchor_bucket(h, buckets))
            if sender.n >= HELD * 100:
                repeated_here()
                yield from sender.out()
            yield from whole.out(HELD * SPAN.itemsize)
        repeated_here()
        yield from sender.out()
        yield from whole.out()

    return run


def _equal_groups(words: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): windows ordered by their digits, and the number of each one's group of equal windows, in that order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    for digit in range(words.shape[1]):
        w = words[order, digit]
        differs = ~new & np.r_[False, w[1:] != w[:-1]]
        if differs.any():  # equal fingerprints, different bytes: order by this digit within the groups, and split them
            order = order[np.lexsort((words[order, digit], np.cumsum(new)))]
            group = key[order]
            w = words[order, : digit + 1]
            new = np.r_[True, (group[1:] != group[:-1]) | (w[1:] != w[:-1]).any(axis=1)]
    return order, np.cumsum(new) - 1


def _windows_of(rows: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, bytes as digits) of every window of these anchors."""
    wide = length + span - 1
    n = (rows["hi"] - rows["lo"] + 1).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    left = np.repeat(rows["hi"].astype(np.int64), n) - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    flat = np.ascontiguousarray(rows["bytes"]).view(np.uint8).reshape(len(rows), wide)
    pad = -length % 8
    view = np.lib.stride_tricks.sliding_window_view(flat, length, axis=1)[row, span - 1 - left]
    digits = np.zeros((len(row), length + pad), np.uint8)
    digits[:, :length] = view
    return row, rows["pos"][row] - left, digits.view("<u8")


def _finger(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _repeats(length: int, span: int, buckets: int):
    dtype = _window_dtype(length, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        rows = _blobs(batches, dtype, passed, squeezed=True)
        yield from passed
        if not len(rows):
            return
        order = np.lexsort((rows["doc"], rows["hash"]))
        first = np.flatnonzero(np.r_[True, rows["hash"][order][1:] != rows["hash"][order][:-1]])
        ends = np.r_[first[1:], len(order)]
        upto = np.r_[0, np.cumsum(rows["hi"][order].astype(np.int64) - rows["lo"][order] + 1)]  # windows of the anchors before each
        by_group = upto[ends]
        most = max(1, CHUNK // (length + -length % 8))
        sender = _Sender(0)

        def send(doc: np.ndarray, start: np.ndarray) -> None:
            if len(doc):
                out = _merged(doc, start, start + length)
                sender.add(out, _bucket(out["doc"], buckets))

        def whole(part: np.ndarray) -> None:
            row, start, words = _windows_of(part, length, span)
            o, group = _equal_groups(words, _finger(words))
            doc = part["doc"][row[o]]
            least = np.minimum.reduceat(doc, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
            again = doc > least[group]
            send(doc[again], start[o][again].astype(np.int64))

        def in_chunks(a: int, end: int) -> None:
            """One anchor of very many documents, in order of doc_id: least document of each window so far."""
            known: dict[bytes, int] = {}
            while a < end:
                b = min(end, max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1))
                part = rows[order[a:b]]
                row, start, words = _windows_of(part, length, span)
                o, equal = _equal_groups(words, _finger(words))
                doc = part["doc"][row[o]]
                at = np.flatnonzero(np.r_[True, equal[1:] != equal[:-1]])
                least = np.minimum.reduceat(doc, at)
                least = np.array([known.setdefault(words[o[i]].tobytes(), int(d)) for i, d in zip(at, least, strict=True)], np.int64)
                again = doc > least[equal]
                send(doc[again], start[o][again].astype(np.int64))
                a = b

        a = 0
        while a < len(first):
            b = int(np.searchsorted(by_group, upto[first[a]] + most, "right"))
            if b > a:
                whole(rows[order[first[a] : ends[b - 1]]])
            else:
                b = a + 1
                in_chunks(first[a], ends[a])
            a = b
            yield from sender.out(HELD * SPAN.itemsize)
        yield from sender.out()

    return run


def covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that these spans cover."""
    if not len(spans):
        return []
    s = spans[np.argsort(spans["start"], kind="stable")]
    reach = np.maximum.accumulate(s["end"])
    new = np.flatnonzero(np.r_[True, s["start"][1:] > reach[:-1]])
    return list(zip(s["start"][new].tolist(), reach[np.r_[new[1:], len(s)] - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for by, batch in _records_then_texts(batches, SPAN):
        ids, size, gone, runs, kept = [], [], [], [], []
        for doc, text in texts(batch):
            b = _bytes(text)
            spans = covered(by[doc]) if doc in by else []
            ids.append(doc)
            size.append(len(b))
            gone.append(sum(y - x for x, y in spans))
            runs.append([{"start": x, "end": y} for x, y in spans])
            kept.append(b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, size, gone, runs, kept), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _beside(records: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Records and texts (with what else docs has) of the same documents in one partition, records first."""
    r = records.select("bucket", F.lit(0).alias("kind"), "blob", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    t = docs.select(F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 7)), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), *docs.columns)
    return r.unionByName(t).repartitionById(buckets, "bucket").sortWithinPartitions("kind")


def _spans(docs: DataFrame, length: int, work: Scratch, buckets: int) -> DataFrame:
    """The repeated windows of all documents, merged where they meet, packed by document."""
    if length < 16:
        raise ValueError("strings must have at least 16 bytes")
    span = length - max(12, min(32, length // 3)) + 1
    docs = docs.where(F.octet_length("text") >= length)
    anchors = docs.mapInArrow(_send_anchors(length, span, buckets), PACKED).repartitionById(buckets, "bucket")
    places = work.save(anchors.mapInArrow(_shared_anchors(buckets), PACKED), "places")
    windows = _beside(places, docs, buckets).mapInArrow(_send_windows(length, span, buckets), PACKED).repartitionById(buckets, "bucket")
    spans = work.save(windows.mapInArrow(_repeats(length, span, buckets), PACKED), "spans")
    work.drop("places")
    return spans


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start and end of each maximal removed run), kept (the remaining bytes)."""
    docs, buckets = id_text(docs), n_buckets(spark, docs)
    spans = _spans(docs, length, Scratch(spark, "substrings"), buckets)
    return _beside(spans, docs, buckets).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def cut_texts(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """The documents, all columns kept, with repeated strings cut from text and n_chars (if there) set anew.

    Characters of which only some bytes are repeated stay. Documents of which no text is left go.
    """
    buckets = n_buckets(spark, docs)
    spans = _spans(id_text(docs), length, Scratch(spark, "substrings"), buckets)
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]).alias("rest")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest).where("doc_id IS NOT NULL")
    schema = f"text string, rest {given.schema['rest'].dataType.simpleString()}"
    cut = _beside(spans, given, buckets).mapInArrow(_whole_characters, schema).where("text <> ''")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return cut.select(*[(new[c] if c in new else F.col(f"rest.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for by, batch in _records_then_texts(batches, SPAN):
        kept = []
        for doc, text in texts(batch):
            b = _bytes(text)
            parts, at = [], 0
            for x, y in covered(by[doc]) if doc in by else []:
                while x < y and b[x] & 0xC0 == 0x80:  # a character that is cut in part stays whole
                    x += 1
                while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
                    y -= 1
                parts.append(b[at:x])
                at = y
            parts.append(b[at:])
            kept.append(b"".join(parts).decode("utf-8", "surrogatepass") if text is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), column(batch, "rest")], ["text", "rest"])
