import random

import numpy as np
import pytest
from helpers import as_rows, documents, near_copies, plain_components, plain_shingles, words

from densefold.llm import jaccard


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 64), (5, 8, 10, 4), (1, 1, 2, 2), (4, 1, 1, 64)])
def test_same_as_all_pairs(spark, k, num, den, block):
    rows = near_copies()
    got = as_rows(jaccard.jaccard_components(spark, documents(spark, rows).repartition(3), k, num, den, block))
    sizes, comp = plain_components(rows, k, num, den)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (sizes[i], comp[i]) for i, _ in rows}


def test_long_lists_take_every_round(spark):
    """A family larger than all list limits, whose members link through each other and seldom through the first."""
    rng = random.Random(3)
    base, rows = words(rng, 60), []
    for i in range(620):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = as_rows(jaccard.jaccard_components(spark, documents(spark, rows), 2, 85, 100, block=4))
    _, comp = plain_components(rows, 2, 85, 100)
    assert {i: r.component_id for i, r in got.items()} == comp


def test_empty_table_and_keep_first(spark):
    assert jaccard.jaccard_components(spark, documents(spark, [])).collect() == []
    text = "a b c d e f g h"
    kept = jaccard.keep_first(spark, documents(spark, [(3, text), (1, text), (2, "other words here"), (4, None), (5, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5] and kept.columns == documents(spark, []).columns


def test_signatures_bound_the_difference():
    rng, pairs = np.random.default_rng(1), []
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 700)).astype(np.uint64)) for _ in "ab")
        b = np.unique(np.concatenate([b[:50], a[: rng.integers(0, len(a) + 1)]]))
        pairs.append((a, b))
    apart = jaccard.differing(*([jaccard.signature(p[k]) for p in pairs] for k in (0, 1)))
    assert len(set(map(len, (jaccard.signature(a) for a, _ in pairs)))) > 3
    assert all(d <= len(np.setxor1d(a, b)) for d, (a, b) in zip(apart.tolist(), pairs, strict=True)) and (apart > 0).any()
    assert jaccard.differing([], []).tolist() == []


def test_sets_are_those_of_word_runs():
    """As many hashes as there are distinct runs, the same for the same runs, and none of different lengths or orders alike."""
    rng = random.Random(5)
    texts = [t for _, t in near_copies()] + ["a b", "b a", "a", "a a a a", "ab", "A\tB\x0bc\x0cD \x85 x", "a\u00a0b c d e"] + [" ".join(words(rng, 300)) for _ in range(20)]
    by = {}
    for t in texts:
        for k in (1, 4, 5):
            runs, hashes = plain_shingles(t, k), jaccard.shingles(t, k)
            assert len(runs) == len(hashes) and (np.diff(hashes.astype(object)) > 0).all()
            by.setdefault(frozenset(runs), set()).add(tuple(hashes.tolist()))
    assert all(len(x) == 1 for x in by.values())
    assert len({tuple(x) for x in by.values()}) == len(by)


def test_bad_similarity(spark):
    with pytest.raises(ValueError, match="similarity"):
        jaccard.jaccard_components(spark, documents(spark, []), num=3, den=2)


def test_repeated_rows(spark):
    text = "a b c d e f g h"
    got = jaccard.jaccard_components(spark, documents(spark, [(5, text), (5, text), (7, text), (9, None), (9, None)]), 4, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (9, 9), (9, 9)]
