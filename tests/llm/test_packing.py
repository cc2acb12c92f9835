import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, near_copies
from tokenizers import Tokenizer

from densefold.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_knapsack_is_optimal():
    rng = random.Random(4)
    for _ in range(40):
        cap = rng.randint(3, 25)
        lengths = sorted(rng.sample(range(1, cap + 1), rng.randint(1, min(6, cap))))
        prices = [rng.random() for _ in lengths]
        best = [0.0] * (cap + 1)
        for c in range(cap + 1):
            best[c] = max([best[c - k] + p for k, p in zip(lengths, prices, strict=True) if k <= c] + [best[c - 1] if c else 0.0])
        found, worth = packing.knapsack(np.array(lengths), np.array(prices), cap)
        assert abs(worth - best[cap]) < 1e-9 and sum(k * n for k, n in found.items()) <= cap
        assert abs(sum(prices[lengths.index(k)] * n for k, n in found.items()) - worth) < 1e-9


@pytest.mark.parametrize("histogram", [{}, {1024: 9}, {512: 7, 513: 5}, {700: 100, 324: 100}, {1: 5000}, {600: 50, 300: 20, 124: 70, 400: 31}, {k: 1 + k % 13 for k in range(1, 1025)}])
def test_plans_cover_the_histogram(histogram):
    plan = packing.solve(histogram, 1024)
    used = defaultdict(int)
    for c, n in plan.configurations:
        assert n > 0 and sum(k * m for k, m in c.items()) <= 1024
        for k, m in c.items():
            used[k] += m * n
    assert dict(used) == histogram
    assert plan.bound - 1e-6 <= plan.n_sequences <= 1.005 * plan.bound + 2
    if histogram:
        assert plan.bound - 1e-6 <= plan.fractional <= 1.15 * plan.bound


def most_full(histogram, cap):
    """Fewest sequences by trying everything, for a few pieces."""
    pieces = sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True)
    best = [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for j in sorted(set(range(len(rooms))), key=lambda j: rooms[j]):
            if rooms[j] >= pieces[i]:
                place(i + 1, [*rooms[:j], rooms[j] - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, cap - pieces[i]])

    place(0, [])
    return best[0]


def test_near_the_optimum_of_small_histograms():
    rng = random.Random(9)
    for _ in range(25):
        cap = rng.randint(10, 40)
        histogram = {k: rng.randint(1, 3) for k in rng.sample(range(1, cap + 1), 4)}
        plan, best = packing.solve(histogram, cap), most_full(histogram, cap)
        assert plan.bound - 1e-6 <= best <= plan.n_sequences <= best + 1


def test_solution_covers_every_length():
    rng = random.Random(2)
    lengths = np.array(sorted(rng.sample(range(1, 200), 60)))
    demand = np.array([float(rng.randint(1, 5000)) for _ in lengths])
    found, value, bound = packing.program(lengths, demand, 200)
    covered = dict.fromkeys(lengths.tolist(), 0.0)
    for c, x in found.items():
        assert sum(k * m for k, m in c) <= 200
        for k, m in c:
            covered[k] += m * x
    assert all(covered[k] >= d * (1 - 1e-6) for k, d in zip(lengths.tolist(), demand, strict=True))
    assert bound <= value <= 1.05 * bound and abs(value - sum(found.values())) < 1e-6 * value


def test_perfect_pairs():
    assert packing.solve({700: 1000, 324: 1000}, 1024).n_sequences == 1000


def test_pieces_and_places(spark):
    rows = near_copies()
    got = packing.pack(spark, documents(spark, rows).repartition(3), PATH, end_id=2, cap=128, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 128 for r in parts[1:])
        assert sum([np.frombuffer(r.ids, "<u4").tolist() for r in parts], []) == ids
        assert all(ids[r.start : r.start + r.length] == np.frombuffer(r.ids, "<u4").tolist() and zlib.crc32(r.ids) == r.ids_crc32 for r in parts)
        assert len(parts) == -(-len(ids) // 128)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= sum(r.length for r in got) / 128 * 1.05 + 2
    assert packing.pack(spark, documents(spark, []), PATH, end_id=2).collect() == []


def test_numbers_over_many_tasks(spark, monkeypatch):
    """Pieces of one length from tasks of several blocks get all places once."""
    monkeypatch.setattr(packing, "PARTS", 3)
    rows = [(i, "some words of a text " * (1 + i % 3)) for i in range(200)]
    got = packing.pack(spark, documents(spark, rows).repartition(11), PATH, end_id=2, cap=64).collect()
    assert len(got) == 200 and len({(r.sequence_id, r.offset) for r in got}) == 200
    full = defaultdict(int)
    for r in got:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 64


def test_repeated_rows(spark):
    got = packing.pack(spark, documents(spark, [(5, "some text"), (5, "some text")]), PATH, end_id=2).collect()
    assert len(got) == 2 and len({(r.sequence_id, r.offset) for r in got}) == 2
