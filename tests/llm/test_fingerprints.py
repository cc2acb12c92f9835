import hashlib
import random

import numpy as np
import pytest
import xxhash
from helpers import as_rows, documents, near_copies, words

from densefold.llm import fingerprints as fp


def plain_anchors(text):
    """Closed syncmers, run by run, over the module's own hashes of inner runs."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h1 = fp._mixed((c + np.uint64(1)) * fp._ODD)
    mask = (1 << 64) - 1
    r = 0x5851F42D4C957F2D
    inner = []
    for i in range(len(c) - fp.S + 1):
        v = 0
        for x in h1[i : i + fp.S].tolist():
            v = (v * r + x) & mask
        inner.append(int(fp._mixed(np.array([v], np.uint64))[0]))
    n = fp.K - fp.S + 1
    return [i for i in range(len(c) - fp.K + 1) if min(inner[i : i + n]) in (inner[i], inner[i + n - 1])]


MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return h ^ (h >> 32)


def plain_fingerprint(text):
    """{hash: first position}, by whole numbers, one run after the other."""
    if not text:
        return {}
    c = [mixed((ord(x) + 1) * 0x9E3779B97F4A7C15 & MASK) for x in text]
    if len(c) < 12:
        return {xxhash.xxh3_64_intdigest(text.encode()) >> 32: 0}

    def run(i, n):
        v = 0
        for x in c[i : i + n]:
            v = (v * 0x5851F42D4C957F2D + x) & MASK
        return mixed(v)

    inner, out = [run(i, 4) for i in range(len(c) - 3)], {}
    for i in range(len(c) - 11):
        if min(inner[i : i + 9]) in (inner[i], inner[i + 8]):
            out.setdefault(run(i, 12) >> 32, i)
    return out or {run(0, 12) >> 32: 0}


def plain_text(f):
    return "".join(f"{h:08x}{p:08x}" for h, p in sorted(f.items()))


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    best = [0] * (len(both) + 1)  # best[k]: longest chain that ends with the pair k - 1
    if len(both) < 1500:
        for k, (_, y) in enumerate(both, 1):
            best[k] = 1 + max((best[m] for m in range(1, k) if both[m - 1][1] <= y), default=0)
        chain = max(best)
    else:
        chain = len(both) if both == sorted(both, key=lambda p: p[1]) else None
    return None if chain is None else chain / (len(a) + len(b) - len(both))


def test_same_as_plain():
    """Fingerprints and likeness of texts and their edited forms, held against a version of its own that shares no code."""
    rng = random.Random(11)
    texts = ["", "x", "elf letters", "exactly12chr", "z" * 300, "\U0001f600 \u6f22" * 40] + [" ".join(words(rng, rng.randint(1, 120))) for _ in range(25)]
    texts += [" ".join(t.split(" ")[len(t) // 9 :]) for t in texts[6:]] + [texts[8] + texts[9], texts[9] + texts[8]]
    plain = [plain_fingerprint(t) for t in texts]
    own = [fp.fingerprint(t) for t in texts]
    for t, f, g in zip(texts, plain, own, strict=True):
        assert fp.as_text(g) == plain_text(f), t
    for _ in range(400):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert fp.likeness(own[i], own[j]) == plain_likeness(plain[i], plain[j])


def test_far_positions_are_told_apart():
    """Beyond 2^24 code points, too."""
    f = (np.array([1, 2], np.uint64), np.array([(1 << 24) + 5, (1 << 32) - 1]))
    assert fp.as_text(f) == "000000010100000500000002ffffffff"
    assert [x.tolist() for x in fp.from_text(fp.as_text(f))] == [[1, 2], [(1 << 24) + 5, (1 << 32) - 1]]


def test_anchors_are_closed_syncmers():
    rng = random.Random(1)
    for _ in range(30):
        t = " ".join(words(rng, rng.randint(4, 60)))
        _, at = fp.anchors(t)
        want = plain_anchors(t)
        assert at.tolist() == (want or ([0] if t else []))


def test_anchors_need_no_context():
    rng = random.Random(2)
    t = " ".join(words(rng, 80))
    h, p = fp.anchors(t)
    for cut in (3, 50):
        h2, p2 = fp.anchors(t[cut:])
        inside = p >= cut
        assert p2.tolist() == (p[inside] - cut).tolist() and h2.tolist() == h[inside].tolist()


def test_likeness():
    rng = random.Random(3)
    a, b = (" ".join(words(rng, 300)) for _ in "ab")
    f = fp.fingerprint
    assert fp.likeness(f(a), f(a)) == 1 and fp.likeness(f(a), f(b)) < 0.1
    half = fp.likeness(f(a), f(fp.edited(a, b)))
    assert 0.15 < half < 0.7 and half == fp.likeness(f(fp.edited(a, b)), f(a))
    assert fp.likeness(f("some words " + a), f(a)) > 0.7, "a shift of all positions is no difference"
    w = a.split(" ")
    rng.shuffle(w)
    assert fp.likeness(f(" ".join(w)), f(a)) < 0.2
    assert fp.likeness(f(""), f(None)) == 1 and fp.likeness(f(""), f(a)) == 0
    back = fp.from_text(fp.as_text(f(a)))
    assert all((x == y).all() for x, y in zip(back, f(a), strict=True))


def test_text_put_in_or_taken_out_costs_its_own_anchors():
    rng = random.Random(6)
    for _ in range(60):
        a = " ".join(words(rng, 300))
        more = " ".join(words(rng, 30))[:100]
        cut = rng.choice([len(a) // 2, rng.randrange(len(a))])
        b = a[:cut] + more + a[cut:]
        fa, fb = fp.fingerprint(a), fp.fingerprint(b)
        assert fp.likeness(fa, fb) == fp.likeness(fb, fa) > 0.75
        twice = b[:200] + more[::-1] + b[200:]
        assert fp.likeness(fa, fp.fingerprint(twice)) > 0.65


def test_chain_is_the_longest():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 12)
        pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        best = {}
        for k, (p, q) in enumerate(sorted(pairs)):
            best[k] = 1 + max((best[m] for m, (_, y) in enumerate(sorted(pairs)[:k]) if y <= q), default=0)
        p, q = np.array(pairs).T
        assert fp._in_order(p, q) == fp._in_order(q, p) == max(best.values())


def test_a_passage_in_very_long_texts_is_found():
    rng = random.Random(8)
    for n, shared in ((20000, 300), (20000, 20), (5000, 10)):
        passage, a, b = words(rng, shared), words(rng, n), words(rng, n)
        at, to = rng.randrange(n - shared), rng.randrange(n - shared)
        a[at : at + shared], b[to : to + shared] = passage, passage
        x, y = (fp.fingerprint(" ".join(t)) for t in (a, b))
        want = len(fp.anchors(" ".join(passage))[0])
        assert want and fp.likeness(x, y) * (len(x[0]) + len(y[0])) > 0.9 * want


def test_every_anchor_is_kept():
    rng = random.Random(9)
    for n in (0, 3, 400, 30000):
        t = " ".join(words(rng, n))
        assert set(fp.fingerprint(t)[0].tolist()) == set(fp.anchors(t)[0].tolist())


@pytest.mark.parametrize("parts", [1, 5])
def test_next_documents_across_partitions(spark, parts):
    rows = near_copies()
    got = as_rows(fp.with_next(spark, documents(spark, rows).repartition(parts)))
    ids = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        e = fp.edited(text[i], after)
        r = got[i]
        assert r.n_chars == len(text[i]) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        mine, its, its_next = (plain_fingerprint(x) for x in (text[i], e, after))
        assert r.fingerprint == plain_text(mine) and r.edited_fingerprint == plain_text(its)
        for got_, other in ((r.near_edited, its), (r.near_next, its_next)):
            want = plain_likeness(mine, other)
            assert want is None or got_ == want
        assert r.near_edited == fp.likeness(fp.fingerprint(text[i]), fp.fingerprint(e)) and r.near_next == fp.likeness(fp.fingerprint(text[i]), fp.fingerprint(after))


def test_one_document_and_none(spark):
    (r,) = fp.with_next(spark, documents(spark, [(1, "abcdef")])).collect()
    assert r.n_chars == 6 and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1
    assert fp.with_next(spark, documents(spark, [])).collect() == []
    assert fp.fingerprints(documents(spark, [(1, None)])).collect()[0].fingerprint == ""


def test_repeated_rows(spark):
    rows = [(1, "one text here"), (1, "one text here"), (2, "another text"), (2, "another text")]
    got = fp.with_next(spark, documents(spark, rows).repartition(4)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 2]


def test_equal_ids_with_other_texts(spark):
    rows = [(5, "five"), (2, None), (2, "two b"), (2, "two a"), (2, ""), (1, "one"), (5, "five too")]
    got = fp.with_next(spark, documents(spark, rows).repartition(3)).collect()
    chain = ["five too", "five", "two b", "two a", "", "", "one"]
    want = sorted(hashlib.sha256(fp.edited(t, chain[(k + 1) % 7]).encode()).hexdigest() for k, t in enumerate(chain))
    assert sorted(r.edited_sha256 for r in got) == want
