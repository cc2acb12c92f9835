import numpy as np
import pytest
from helpers import union
from oracle import DATA

from densefold.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, cell string, links string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, *["x"] * 5) for i, v, lab in rows], SCHEMA)


def plain(rows, least=0.98):
    ok = {}
    for i, v, lab in rows:
        if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[i] = (x / np.linalg.norm(x), lab)
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= least]
    n = {i: 0 for i, _, _ in rows}
    for p in pairs:
        for i in p:
            n[i] += 1
    return n, union(pairs, n)


def check(spark, rows, **kw):
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark, frame(spark, rows).repartition(3), **kw).collect()}
    n, comp = plain(rows)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in n}


def family(seed=0, size=260):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for lab in (1, 2):
        base = rng.normal(size=(size // 4, 8))
        for b in base:
            for _ in range(2):
                rows.append((k * 7 % 10007, (b + rng.normal(size=8) * rng.choice([0.01, 0.05, 0.1])).tolist(), lab))
                k += 1
    return rows


def test_same_as_all_pairs(spark):
    rows = family()
    same = rows[0][1]
    rows += [(20000 + i, same, 1) for i in range(30)] + [(20100, same, 2), (20101, [2 * x for x in same], 1)]
    rows += [(30000, None, 1), (30001, [0.0] * 8, 1), (30002, [float("nan")] + [1.0] * 7, 1), (30003, [float("inf")] + [1.0] * 7, 1), (30004, [None] + [1.0] * 7, 1), (30005, same, None), (30006, [], 1), (30007, [1.0, 2.0], 1), (30008, [1.0, 2.0], 1), (30009, [-0.0, 1.0], 1), (30010, [0.0, 1.0], 1)]
    check(spark, rows)


def test_cells_and_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    check(spark, family(1), margin=0.2)


def test_blocks_of_a_large_cell():
    """Two blocks of one cell see the links that one block with both halves sees."""
    import pyarrow as pa

    rows = [r for r in family(2, 100) if r[2] == 1]
    def table(part, p, q, side):
        return pa.table({"rep": [r[0] for r in part], "n": [1] * len(part), "home": [0] * len(part), "cell": [0] * len(part), "side": side, "p": [p] * len(part), "q": [q] * len(part), "vector": [np.array(r[1]).tobytes() for r in part]})
    run = embeddings._compare(0.98)
    whole = {r["rep"]: r["links"] for r in run(table(rows, 0, 0, [0] * len(rows))).to_pylist()}
    half = len(rows) // 2
    parts = [run(table(rows[:half], 0, 0, [0] * half)), run(table(rows[half:], 1, 1, [0] * (len(rows) - half))), run(table(rows, 0, 1, [0] * half + [1] * (len(rows) - half)))]
    summed = {}
    for t in parts:
        for r in t.to_pylist():
            summed[r["rep"]] = summed.get(r["rep"], 0) + r["links"]
    assert summed == whole and whole


def test_recall_with_many_cells(spark, monkeypatch):
    """Random vectors with planted near copies, in cells far smaller than usual: recall over 0.9, no false link."""
    monkeypatch.setattr(embeddings, "CELL", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 64))
    near = base[:300] + rng.normal(size=(300, 64)) * 0.12
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark, frame(spark, rows)).collect()}
    n, _ = plain(rows)
    assert all(got[i] <= n[i] for i in n) and sum(got.values()) >= 0.98 * sum(n.values()) > 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    n, comp = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark, df).collect()}
    assert got == {i: (n[i], comp[i]) for i in n}


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark, frame(spark, [])).collect() == []
    with pytest.raises(ValueError, match="cosine"):
        embeddings.near_duplicates(spark, frame(spark, []), least=2)


def test_repeated_rows(spark):
    got = embeddings.near_duplicates(spark, frame(spark, [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (4, [3.0, -1.0], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(4, 0, 4), (5, 1, 5), (5, 1, 5)]


@pytest.mark.parametrize("seed,cell,block", [(2, 4, 1024), (3, 8, 1024), (4, 6, 7)])
def test_no_link_is_missed_at_boundaries(spark, monkeypatch, seed, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(seed)
    check(spark, [(i, rng.normal(size=3).tolist(), 1) for i in range(300)])
