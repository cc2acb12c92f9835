"""Near-duplicate vectors among those of equal label, by cosine in double precision.

Method: spherical k-means gives cells; within a cell, blocks of vectors are compared by matrix products; of each group of linked
vectors the one of the least id is kept.

* Equal vectors of a label are one representative with a multiplicity, so copies are never paired with each other.
* Centroids are fitted on a bounded sample (``SAMPLE`` representatives of least hash); all vectors are assigned. A vector also visits every
  cell whose boundary is nearer than ``margin``. A pair is counted once: in the lesser of its two home cells, or in the other one where only
  that holds both. The boundary lies between two vectors of different cells, so one of them is no further from it than half their chord: with
  the default margin, half the greatest chord of a link, no link is missed; a smaller one misses some.
* A cell of more than ``BLOCK`` vectors is cut into blocks, and each pair of blocks is a task of its own, so that no group
  outgrows a task. Only counts and a spanning set of links leave a block, never all pairs.

Vectors that are null, empty, all zero, or hold null or non-finite components, and vectors without a label, link with nothing. Vectors of
different length don't link; the 100 commonest lengths get cells, others are one cell a label, compared block by block. Ids must be unique and not null (rows with a null id are left out); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densefold.llm.common import Scratch, column, components

SAMPLE = 20_000
#: Representatives a cell should hold per label, and the most cells there are.
CELL = 500
MOST_CELLS = 4096
BLOCK = 1024
TURNS = 8


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, labels, dims, vectors = [], [], [], [], []
        for i, v, label in zip(column(batch, "vec_id").to_pylist(), column(batch, "embedding"), column(batch, "label").to_pylist(), strict=True):
            ok = label is not None and v.is_valid and len(v) > 0 and v.values.null_count == 0
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0 if ok else None
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            raw = x.tobytes() if ok else None
            ids.append(i)
            keys.append(xxhash.xxh3_128_digest(raw) if ok else None)
            labels.append(label if ok else None)
            dims.append(len(x) if ok else None)
            vectors.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "key", "label", "dim", "vector"])


def unit(blobs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    """Spherical k-means from the first k distinct vectors; empty cells keep their centroid."""
    c = x[:k].copy()
    for _ in range(turns):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def _assign(fitted, margin: float):
    """Each representative in its home cell and in those it lies near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances: dict[int, np.ndarray] = {}  # between the centroids, made once a task
        for batch in batches:
            dims = np.array(column(batch, "dim").to_pylist())
            blobs = column(batch, "vector").to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                c = fitted.value.get(dim)
                if c is None or len(c) == 1:
                    row, cell, home = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                    visits = [b"\x80"] * len(rows)
                else:
                    if dim not in distances:
                        distances[dim] = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
                    apart = distances[dim]
                    row, cell, home, visits = [], [], [], []
                    for start in range(0, len(rows), 1024):  # rows by cells, block by block
                        sims = unit([blobs[i] for i in rows[start : start + 1024]]) @ c.T
                        best = sims.argmax(axis=1)
                        near = (sims[np.arange(len(best)), best][:, None] - sims) <= margin * apart[best]
                        near[np.arange(len(best)), best] = True
                        i, j = np.nonzero(near)
                        row.append(i + start)
                        cell.append(j)
                        home.append(best[i])
                        bits = [bits.tobytes() for bits in np.packbits(near, axis=1)]
                        visits += [bits[k] for k in i.tolist()]
                    row, cell, home = map(np.concatenate, (row, cell, home))
                part = batch.take(pa.array(rows[row]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(home.astype(np.int32)), pa.array(visits, pa.binary())], [*part.schema.names, "cell", "home", "visits"])

    return run


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n nodes over edges (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if (label == before).all():
            return label


def _compare(least: float):
    """Of two blocks of a cell (or one with itself): links counted for each vector, and for each its group's least member here."""

    def run(group: pa.Table) -> pa.Table:
        ids, size, home, cell = (group.column(c).to_numpy() for c in ("rep", "n", "home", "cell"))
        side, first = group.column("side").to_numpy(), group.column("p").to_numpy() == group.column("q").to_numpy()
        order = np.argsort(ids)
        ids, size, home, cell, side = ids[order], size[order], home[order], cell[order], side[order]
        x = unit([group.column("vector")[int(k)].as_py() for k in order])
        if first.all():
            a = b = np.arange(len(ids))
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked = (x[a] @ x[b].T) >= least
        if a is b:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        i, j = a[i], b[j]
        if (home != cell).any():
            # Counted in the lesser home, or in the greater one if its own vector doesn't visit the lesser.
            visits = np.frombuffer(b"".join(group.column("visits")[int(k)].as_py() for k in order), np.uint8).reshape(len(ids), -1)
            low, high = np.minimum(home[i], home[j]), np.maximum(home[i], home[j])
            own = np.where(home[i] == high, i, j)
            both = (visits[own, low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1
            here = (cell[i] == low) | ((cell[i] == high) & ~both)
            i, j = i[here], j[here]
        links = np.bincount(i, weights=size[j], minlength=len(ids)) + np.bincount(j, weights=size[i], minlength=len(ids))
        label = _spanning(i, j, len(ids))
        some = np.flatnonzero(links > 0)
        return pa.table({"rep": pa.array(ids[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(ids[label[some]], pa.int64())})

    return run


def near_duplicates(spark: SparkSession, rows: DataFrame, least: float = 0.98, margin: float | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links (vectors linked directly), component_id (least vec_id reachable), kept."""
    if not -1 < least <= 1:
        raise ValueError("the cosine must lie between -1 and 1")
    margin = 0.5 * (2 - 2 * least + 1e-12) ** 0.5 if margin is None else margin
    work = Scratch(spark, "embeddings")
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).where("vec_id IS NOT NULL")
    read = work.save(given.mapInArrow(_read, "vec_id long, key binary, label string, dim int, vector binary"), "read")
    good = read.where("key IS NOT NULL")
    reps = work.save(good.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("vector").alias("vector")), "reps")

    fitted = {}
    total = {r["dim"]: r for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).orderBy(F.desc("n")).limit(100).collect()}
    for dim, r in total.items():
        k = min(MOST_CELLS, max(1, round(r["n"] / (r["labels"] * CELL))))
        if k > 1:
            some = reps.where(F.col("dim") == dim).select("vector", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE).collect()
            fitted[dim] = centroids(unit([bytes(s["vector"]) for s in some]), min(k, len(some)))
    shared = spark.sparkContext.broadcast(fitted)
    cells = reps.select("rep", "n", "label", "dim", "vector").mapInArrow(_assign(shared, margin), "rep long, n long, label string, dim int, vector binary, cell int, home int, visits binary")
    cells = work.save(cells, "cells")
    blocks = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = cells.join(blocks, ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("label", "dim", "cell", "home", "visits", "rep", "n", "vector", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    found = work.save(cut.groupBy("label", "dim", "cell", "p", "q").applyInArrow(_compare(least), "rep long, links long, root long"), "found")
    work.drop("cells")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(work, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "group").select(F.col("id").alias("rep"), "component")
    summary = reps.select("label", "dim", "key", "rep", "n").join(links, "rep", "left").join(group, "rep", "left")
    out = read.select("vec_id", "label", "dim", "key").join(summary, ["label", "dim", "key"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
