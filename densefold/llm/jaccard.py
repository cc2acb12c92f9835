"""Exact n-gram Jaccard self-join: sets of word shingles, linked from a given similarity on.

Method: set-relation skipping over inverted lists.

* Index. A set's prefix (as many of its tokens, in one global order, as two similar sets must meet in) is
  dealt by token. Rare tokens come first: a counting table of fixed size over all tokens of all documents
  tells the frequent ones, which go last. Any total order gives the same links, so collisions in it cost
  work only. A list holds its sets by size and id, with the position at which each holds the token and the token before it: two sets whose
  token before is the same met in that one's list already, so of each run of tokens that they share only the first list considers them.
* Lists of at most ``block`` sets give all pairs that size and position admit; those with the list's first set are looked at before the others,
  of which pairs that are in one component by then need no comparison. Longer ones are cut into blocks of so many; a set skips the
  blocks whose sizes or positions leave no room for the similarity, and those that lie in its own component as a whole.
* Longer lists start with their first set alone (rank 0). What was computed for it then serves its like:
  sets that are in one component already need no comparison; and with |x∩l| and |y∩l| known, |x∩y| lies between
  |x∩l| + |y∩l| - |l| and min(|x∩l| + |y\\l|, |y∩l| + |x\\l|), which often settles a pair. What is left goes on in
  rounds with ranks 1-7, 8-63, 64-511 and all others, so no pair that could add a link is left out.
* Equal sets within a task enter the index once.

Candidates are first held against signatures: the parities of a set's tokens in about two bits a token. Each differing
bit needs a token in which the sets differ, so pairs with too many of them can't link. What remains is checked on the
whole sets, of 64-bit token hashes. Only prefixes, signatures and the sets of such candidates are shuffled; texts never are.

Nulls and texts without words give the empty set, which links with nothing. Ids must be unique and not null (rows with a
null id are left out). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densefold.llm.common import PACKED, Scratch, column, components, id_text, n_buckets, packed, texts

_hash = xxhash.xxh3_64_intdigest
#: Counters of the frequency table (two bytes each while counting, one afterwards: 2 MB are broadcast, whatever the input).
COUNTERS = 1 << 21
#: Tables of fixed size travel from each task in so many compressed slices, which as many tasks add up.
SLICES = 64
#: Bits of the filter over candidate ids (2 MB broadcast). Past some millions of candidates it lets more texts be parsed than needed; results don't change.
FILTER_BITS = 24
ENTRY = np.dtype([("token", "<u8"), ("prev", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4")])
LINK = np.dtype([("a", "<i8"), ("b", "<i8")])
RANKS = (1, 8, 64, 512)
#: Tokens, entries or pairs that a task holds before it sums them up or sends them.
HELD = 300_000


_TIMES = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of so many words; a shorter text is one run; no words, no hashes.

    Words are split at ASCII white space and only A-Z are lowered, which is what bytes methods do. The hash of a run is made of those of its
    words in their order, and of how many they are.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_hash, w), np.uint64, len(w))
    k = min(words, len(w))
    runs = len(w) - k + 1
    h = np.full(runs, k, np.uint64)
    for i in range(k):
        h = (h ^ each[i : i + runs]) * _TIMES
        h ^= h >> np.uint64(29)
    h.sort()
    new = np.empty(runs, bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def signature(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit; 64 to 4096 bits, a power of two."""
    bits = min(4096, max(64, 1 << (2 * len(tokens) - 1).bit_length())) if len(tokens) else 64
    at = ((tokens >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the signatures of each pair differ, the longer one folded to the length of the shorter: at most the tokens that only one set has."""
    m, n = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    out = np.zeros(len(a), np.int64)
    kind = m * (1 << 20) + n
    for k in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == k)
        x, y = (np.frombuffer(b"".join([s[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1) for s in (a, b))
        while x.shape[1] != y.shape[1]:
            x, y = (x, y) if x.shape[1] < y.shape[1] else (y, x)
            half = y.shape[1] // 2
            y = y[:, :half] ^ y[:, half:]
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def _count(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("blob", pa.binary())])  # of a document or of a slice

        def count(sets: list[np.ndarray]) -> None:
            total[:] += np.bincount(_counter_of(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)

        for batch in batches:
            sizes, signs, held, n_held = [], [], [], 0
            for _, text in texts(batch):
                tokens = shingles(text, words)
                sizes.append(len(tokens))
                signs.append(signature(tokens))
                held.append(tokens)
                n_held += len(tokens)
                if n_held > HELD:
                    count(held)
                    held, n_held = [], 0
            if held:
                count(held)
            if sizes:
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.array(signs, pa.binary())], schema=schema)
        if total.any():
            parts = np.minimum(total, 65535).astype("<u2").reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], schema=schema)

    return run


def _merge(least: float):
    """Sum of the tables of all tasks, as frequency classes: 0 for rare, else the whole base-2 logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(column(batch, "slice").to_pylist(), column(batch, "blob"), strict=True):
                part = np.frombuffer(zlib.decompress(blob.as_buffer()), "<u2").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, s in sums.items():
            kind = np.where(s > least, np.log2(np.maximum(s, 1)).astype(np.uint8), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind.tobytes()], pa.binary())], ["slice", "blob"])

    return run


def _prefix(tokens: np.ndarray, kinds: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of a set in the global order (frequency class, hash)."""
    size = len(tokens) - -(-num * len(tokens) // den) + 1
    kind = kinds[_counter_of(tokens)]
    rare = tokens[kind == 0]
    if len(rare) >= size:
        return rare[:size]
    often = kind > 0
    return np.concatenate([rare, tokens[often][np.lexsort((tokens[often], kind[often]))]])[:size]


def _index(words: int, num: int, den: int, buckets: int, kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held, same, n_held = [], [], 0

        def out():
            if held:
                rows = np.concatenate(held)
                yield packed(rows, ((rows["token"] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64), 1)
            if same:
                rows = np.array(same, LINK)
                yield packed(rows, rows["a"] % buckets, 0)

        for batch in batches:
            for doc, text in texts(batch):
                tokens = shingles(text, words)
                if not len(tokens):
                    continue
                first = seen.setdefault(xxhash.xxh3_128_digest(tokens.tobytes()), doc)
                if first != doc:
                    same.append((doc, first))
                    continue
                prefix = _prefix(tokens, kinds.value, num, den)
                rows = np.empty(len(prefix), ENTRY)
                rows["token"], rows["doc"], rows["n"], rows["pos"] = prefix, doc, len(tokens), np.arange(len(prefix))
                rows["prev"][:1], rows["prev"][1:] = 0, prefix[:-1]
                held.append(rows)
                n_held += len(rows)
                if n_held > HELD:
                    yield from out()
                    held, same, n_held = [], [], 0
        yield from out()

    return run


LISTS = "kind int, token long, prev long, rank int, doc long, n int, pos int, lead long"


def _rows(kind: int, **cols) -> pa.RecordBatch:
    n = len(cols["doc"])
    types = {"token": pa.int64(), "prev": pa.int64(), "rank": pa.int32(), "doc": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "lead": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(cols[c]), t) if c in cols else pa.nulls(n, t) for c, t in types.items())], ["kind", *types])


def _admits(na, nb, pa_, pb, num: int, den: int):
    """Whether two sets of these sizes that first meet at these positions can be similar enough."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    need = -(-num * (na + nb) // (num + den))
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= need)


def _lists(num: int, den: int, block: int):
    """Candidates (doc and lead) of all lists of a partition: with a list's first set (kind 1), and others of short lists (kind 3); entries of long lists (kind 2); links of equal sets (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for kind, blob in zip(column(batch, "kind").to_pylist(), column(batch, "blob"), strict=True):
                if kind == 1:
                    got.append(np.frombuffer(blob.as_buffer(), ENTRY))
                else:
                    link = np.frombuffer(blob.as_buffer(), LINK)
                    yield _rows(0, doc=link["a"], lead=link["b"])
        if not got:
            return
        e = np.concatenate(got)
        del got
        _, inverse, count = np.unique(e["token"], return_inverse=True, return_counts=True)
        e = e[count[inverse] > 1]
        e = e[np.lexsort((e["doc"], e["n"], e["token"]))]
        if not len(e):
            return
        start = np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1]])
        length = np.diff(np.r_[start, len(e)])
        docs, mine = np.unique(e["doc"], return_inverse=True)
        found = {1: [np.zeros(0, np.int64)], 3: [np.zeros(0, np.int64)]}

        def add(kind: int, x: np.ndarray, y: np.ndarray) -> None:
            """Pairs of entries, as one number each; repeats go now and then."""
            before = (e["prev"][x] == e["prev"][y]) & (e["pos"][x] > 0) & (e["pos"][y] > 0)
            ok = ~before & _admits(e["n"][x], e["n"][y], e["pos"][x], e["pos"][y], num, den)
            a, b = mine[x[ok]], mine[y[ok]]
            found[kind].append(np.minimum(a, b) * len(docs) + np.maximum(a, b))
            if sum(map(len, found[kind][1:])) > HELD:
                found[kind][:] = [np.unique(np.concatenate(found[kind]))]

        for size in np.unique(length[length <= block]).tolist():
            at = start[length == size]
            i, j = np.triu_indices(size, 1)
            for part in np.array_split(at, max(1, len(at) * len(i) // HELD)):
                for kind, with_first in ((1, i == 0), (3, i > 0)):
                    add(kind, (part[:, None] + i[with_first]).ravel(), (part[:, None] + j[with_first]).ravel())
        for s, k in zip(start[length > block].tolist(), length[length > block].tolist(), strict=True):
            one = e[s : s + k]
            yield _rows(2, token=one["token"].astype(np.int64), prev=one["prev"].astype(np.int64), rank=np.arange(k), doc=one["doc"], n=one["n"], pos=one["pos"], lead=np.full(k, one["doc"][0]))
            add(1, np.full(k - 1, s), np.arange(s + 1, s + k))
        for kind, parts in found.items():
            pairs = np.unique(np.concatenate(parts))
            for k in range(0, len(pairs), HELD):
                yield _rows(kind, doc=docs[pairs[k : k + HELD] % len(docs)], lead=docs[pairs[k : k + HELD] // len(docs)])

    return run


def _filter_bit(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _id_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices that a task has ids in."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_filter_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
    parts = np.packbits(bits).reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())], ["slice", "blob"])


def _or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(column(batch, "slice").to_pylist(), column(batch, "blob"), strict=True):
            part = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint8)
            found[k] = found[k] | part if k in found else part
    for k, part in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "blob"])


def _sets(words: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[_filter_bit(column(batch, "doc_id").to_numpy(zero_copy_only=False))]))
            found = [(i, shingles(t, words)) for i, t in texts(batch)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "tokens"])

    return run


def _possible(num: int, den: int, also: list[str] = ()):
    """Pairs whose signatures leave room for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = column(batch, "na").to_numpy() + column(batch, "nb").to_numpy()
            room = total - 2 * -(-num * total // (num + den))
            apart = differing(column(batch, "xa").to_pylist(), column(batch, "xb").to_pylist())
            yield batch.filter(pa.array(apart <= room)).select(["a", "b", *also])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (column(batch, c) for c in ("a", "b"))
            both = []
            for x, y in zip(column(batch, "sa"), column(batch, "sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)  # both ascend
                both.append((int((x[at] == y).sum()), len(x), len(y)))
            m = np.array(both, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(m[:, 2]), pa.array(den * m[:, 0] >= num * (m[:, 1] + m[:, 2] - m[:, 0]))], ["a", "b", "both", "na", "nb", "linked"])

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, block: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links, itself included).

    Two documents link when den * |intersection| >= num * |union| of their sets of shingles of so many words.
    """
    if not 0 < num <= den or words < 1:
        raise ValueError("the similarity num/den must be over 0 and at most 1, and shingles must have words")
    work, buckets = Scratch(spark, "jaccard"), n_buckets(spark, docs)
    docs = id_text(docs)
    counted = work.save(docs.mapInArrow(_count(words), "doc_id long, n long, slice int, blob binary"), "counted")
    sizes = counted.where("doc_id IS NOT NULL").select("doc_id", "n")
    signs = counted.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "n", F.col("blob").alias("x"))
    mean = (sizes.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    slices = counted.where("slice IS NOT NULL").select("slice", "blob").repartitionById(SLICES, "slice")
    kinds = np.zeros(COUNTERS, np.uint8).reshape(SLICES, -1)
    for row in slices.mapInArrow(_merge(mean + 64 + 8 * mean**0.5), "slice int, blob binary").collect():
        kinds[row["slice"]] = np.frombuffer(row["blob"], np.uint8)
    kinds = spark.sparkContext.broadcast(kinds.reshape(-1))
    dealt = docs.mapInArrow(_index(words, num, den, buckets, kinds), PACKED).repartitionById(buckets, "bucket")
    lists = work.save(dealt.mapInArrow(_lists(num, den, block), LISTS), "lists")

    links = lists.where("kind = 0").select(F.col("doc").alias("a"), F.col("lead").alias("b"))

    def possible(two: DataFrame, name: str) -> DataFrame:
        with_b = two.join(signs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb")).hint("merge"), "b")
        with_a = with_b.join(signs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa")).hint("merge"), "a")
        return work.save(with_a.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_possible(num, den), "a long, b long"), name)

    def candidates(kind: int) -> DataFrame:
        return lists.where(F.col("kind") == kind).select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()

    pairs, others = possible(candidates(1), "pairs"), possible(candidates(3), "others")
    long = lists.where("kind = 2")

    def ends(two: DataFrame) -> DataFrame:
        return two.select(F.col("a").alias("id")).unionByName(two.select(F.col("b").alias("id")))

    def id_filter(ids: DataFrame):
        bits = np.zeros((SLICES, (1 << FILTER_BITS) // 8 // SLICES), np.uint8)
        parts = ids.mapInArrow(_id_filter, "slice int, blob binary").repartitionById(SLICES, "slice")
        for row in parts.mapInArrow(_or, "slice int, blob binary").collect():
            bits[row["slice"]] = np.frombuffer(row["blob"], np.uint8)
        return spark.sparkContext.broadcast(bits.reshape(-1))

    def verified(two: DataFrame, name: str) -> DataFrame:
        # Sets are made anew from the texts of the ids that a step needs: quicker than to keep them all, which would take more room than the texts do.
        needed = docs.mapInArrow(_sets(words, id_filter(ends(two))), "id long, tokens binary")
        # They have no size bound, so they are shuffled at every size of the input, never broadcast.
        with_b = two.join(needed.select(F.col("id").alias("b"), F.col("tokens").alias("sb")).hint("merge"), "b")
        with_a = with_b.join(needed.select(F.col("id").alias("a"), F.col("tokens").alias("sa")).hint("merge"), "a")
        return work.save(with_a.select("a", "b", "sa", "sb").mapInArrow(_verify(num, den), "a long, b long, both long, na long, nb long, linked boolean"), name)

    first = verified(pairs, "verified0")
    links = links.unionByName(first.where("linked").select("a", "b"))
    known = components(work, links, "round0")
    # Of the other pairs only those that lie in different components by now.
    a, b = known.select(F.col("id").alias("a"), F.col("component").alias("ca")), known.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    apart = others.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    apart = work.save(apart.join(first.select("a", "b"), ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        known = _joined(work, known, verified(apart, "verified_apart").where("linked").select("a", "b"), "round_apart")
    top = long.agg(F.max("rank")).first()[0] or 0
    if top >= RANKS[0]:
        # What was computed for the first set of a list, for each of its other sets; and all signatures.
        answers = first.select(F.col("b").alias("doc"), F.col("a").alias("lead"), "both", F.col("na").alias("n_lead")).unionByName(first.select(F.col("a").alias("doc"), F.col("b").alias("lead"), "both", F.col("nb").alias("n_lead")))
        with_answers = long.join(answers, ["doc", "lead"], "left").join(signs.select(F.col("id").alias("doc"), "x").distinct().hint("merge"), "doc")
        long = work.save(with_answers.select("token", "prev", "rank", "doc", "n", "pos", "both", "n_lead", "x"), "long")
    for r, low in enumerate(RANKS):
        if top < low:
            break
        high = RANKS[r + 1] if r + 1 < len(RANKS) else top + 1
        label = known.select(F.col("id").alias("doc"), "component")
        entries = work.save(long.join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc")), f"entries{r}")
        if entries.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").isEmpty():
            break  # every list lies in one component
        new = work.save(_met(entries, low, high, num, den, block).distinct(), f"met{r}")
        if new.isEmpty():
            continue
        checked = verified(new.where("NOT sure").select("a", "b"), f"verified{r + 1}")
        known = _joined(work, known, new.where("sure").select("a", "b").unionByName(checked.where("linked").select("a", "b")), f"round{r + 1}")
    return sizes.join(known.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _met(entries: DataFrame, low: int, high: int, num: int, den: int, block: int) -> DataFrame:
    """(a, b, sure): pairs of a set of these ranks and one of a higher rank in its list that may link and lie in different components.

    ``sure`` pairs link by the answers of the list's first set alone.
    """
    led = entries.where((F.col("rank") >= low) & (F.col("rank") < high))
    # Blocks of each list that a set can skip: too small or large, too far on in their sets, or all in its own component.
    part = F.expr(f"rank div {block}").alias("part")
    blocks = entries.groupBy("token", part).agg(
        F.max("rank").alias("r1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("left"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    meets = (F.col("r1") > F.col("rank")) & (den * F.col("n") >= num * F.col("n0")) & (den * F.col("n1") >= num * F.col("n")) & ~((F.col("c0") == F.col("component")) & (F.col("c1") == F.col("component")))
    meets = meets & (F.least("left", F.col("n") - F.col("pos")) >= F.ceil((num * (F.col("n0") + F.col("n"))) / (num + den) - F.lit(1e-9)))
    led = led.join(blocks, "token").where(meets).drop("r1", "n0", "n1", "left", "c0", "c1")
    x, y, c = entries.withColumn("part", part).alias("x"), led.alias("y"), F.col
    need = F.ceil((num * (c("x.n") + c("y.n"))) / (num + den) - F.lit(1e-9))
    most = F.least(c("x.both") + c("y.n") - c("y.both"), c("y.both") + c("x.n") - c("x.both"))
    met = x.join(
        y,
        (c("x.token") == c("y.token")) & (c("x.part") == c("y.part")) & (c("x.rank") > c("y.rank")) & (c("x.component") != c("y.component"))
        & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
        & ((c("x.prev") != c("y.prev")) | (c("x.pos") == 0) | (c("y.pos") == 0))
        & (F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos")) >= need)
        & F.coalesce(most >= need, F.lit(True)),
    )
    sure = F.coalesce(c("x.both") + c("y.both") - c("x.n_lead") >= need, F.lit(False)).alias("sure")
    pair = met.select(c("x.doc").alias("a"), c("y.doc").alias("b"), sure, c("x.n").cast("bigint").alias("na"), c("y.n").cast("bigint").alias("nb"), c("x.x").alias("xa"), c("y.x").alias("xb"))
    left = pair.mapInArrow(_possible(num, den, also=["sure"]), "a long, b long, sure boolean")
    return left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure")


def _joined(work: Scratch, known: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(id, component) after more links."""
    links = work.save(links, f"{name}-links")
    if links.isEmpty():
        return known
    a, b = known.select(F.col("id").alias("a"), F.col("component").alias("ca")), known.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(work, between, name).select(F.col("id").alias("component"), F.col("component").alias("top"))
    old = known.join(moved, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    new = moved.join(known, moved["component"] == known["id"], "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component"))
    return work.save(old.unionByName(new), f"{name}-known")


def keep_first(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents with the least id of their component, all columns kept."""
    gone = jaccard_components(spark, docs, words, num, den).where("component_id <> doc_id").select("doc_id")
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("kept"))
    return whole.join(gone, "doc_id", "left_anti").select(*[F.col(f"kept.c{k}").alias(c) for k, c in enumerate(docs.columns)])
