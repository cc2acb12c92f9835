"""Small fixtures, and plain versions of the operators to hold them against."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind string, blob string, id string, n string, component string, label string, spans string, score string, lang_pred string, kept string, _text string, _gone string"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang). Extra columns carry names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), *["x"] * 13) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(["th", "er", "on", "an", "ré", "st", "ou", "n", "漢"], k=rng.randint(1, 4))) for _ in range(n)]


def near_copies(seed: int = 5) -> list[tuple[int, str | None]]:
    """Texts of all the awkward kinds: null, empty, blank, tiny, very long, equal, and families of near copies."""
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \t\n", "one", "one two three", "One  two\nthree", "ONE TWO THREE"]
    line = " ".join(words(rng, 14))
    for size in (12, 40, 90):
        base = words(rng, size)
        out += [" ".join(base)] * 5
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(size)] = rng.choice(words(rng, 3))
            out.append(" ".join(w))
    out += [line + " " + " ".join(words(rng, 30)) for _ in range(80)]
    out.append(" ".join(words(rng, 30000)))
    rng.shuffle(out)
    ids = rng.sample(range(-50, 5000), len(out))
    return list(zip(ids, out, strict=True))


def union(pairs, ids) -> dict[int, int]:
    """Least id of each component."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, num, den):
    sets = {i: plain_shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union(pairs, ids)


def plain_removed(rows, length):
    """(kept bytes, bytes removed, runs) of each document."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            own.add(w)
            if w in seen:
                gone[k : k + length] = b"\1" * length
        seen |= own
        out[i] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), gone)
    return out


def plain_bayes(learn, texts, buckets=1 << 15, sharp=20):
    """(label, score) of each text by a naive Bayes of dictionaries and logarithms. learn: (text, label)."""
    def grams(text):
        kept = " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split(" ")).split()
        kept = f" {' '.join(kept)} " if kept else ""
        out = Counter()
        for n in (1, 2, 3):
            for k in range(len(kept) - n + 1):
                h = 0
                for m, c in enumerate(kept[k : k + n], 1):
                    h = (h * 0x100000001B3 + ord(c) + m) % 2**64
                out[(h * 0x9E3779B97F4A7C15 % 2**64) >> 49] += 1
        return out

    counts, documents = {}, Counter()
    for text, label in learn:
        if text is not None and label is not None:
            documents[label] += 1
            counts.setdefault(label, Counter()).update(grams(text))
    size = {x: sum(c.values()) + buckets for x, c in counts.items()}
    out = []
    for text in texts:
        own = grams(text)
        if not own or not counts:
            out.append(("und", 0.0))
            continue
        like = {x: sum(m * math.log((c[f] + 1) / size[x]) for f, m in own.items()) for x, c in counts.items()}
        best = min(like, key=lambda x: (-(like[x] + math.log(documents[x] / sum(documents.values()))), x))
        n = sum(own.values())
        out.append((best, 1 / sum(math.exp(min(50.0, (v - like[best]) / n * sharp)) for v in like.values())))
    return out


def as_rows(df) -> dict[int, Row]:
    return {r[0]: r for r in df.collect()}
