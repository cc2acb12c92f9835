import random

import pytest
from helpers import as_rows, documents, near_copies, plain_removed, words

from densefold.llm import substrings


def check(spark, rows, length, parts=3):
    got = as_rows(substrings.remove_repeats(spark, documents(spark, rows).repartition(parts), length))
    want = plain_removed(rows, length)
    assert set(got) == set(want)
    for i, t in rows:
        kept, gone, runs, _ = want[i]
        r = got[i]
        assert (bytes(r.kept), r.n_removed, len(r.spans), r.n_bytes) == (kept, gone, runs, len((t or "").encode())), i


@pytest.mark.parametrize("length", [16, 50, 150])
def test_same_as_all_windows(spark, length):
    check(spark, near_copies(), length)


def test_low_complexity_and_edges(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 30))
    rows = [(1, "a" * 300), (2, "a" * 49), (3, "a" * 50), (4, "ab" * 200), (5, "ba" * 200), (6, None), (7, ""), (8, passage), (9, "x" + passage[:60] + "y" + passage[20:] + "z"), (0, passage[10:70]), (10, passage * 3), (11, "a" * 300)]
    rows += [(20 + i, f"{i}{passage[:55]}{i * 7}") for i in range(60)]
    check(spark, rows, 50, 4)


def test_hot_anchor_in_chunks(spark, monkeypatch):
    """A passage that all documents hold: one group, worked off in many chunks."""
    monkeypatch.setattr(substrings, "CHUNK", 7)
    rng = random.Random(1)
    passage = " ".join(words(rng, 20))
    rows = [(i, f"{' '.join(words(rng, 5))} {passage} {' '.join(words(rng, 5))}") for i in range(80)]
    want = plain_removed(rows, 50)
    import numpy as np
    import pyarrow as pa

    def run(step, batches):
        return [b for b in step(iter(batches)) if b.num_rows]

    docs = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})]
    length, span = 50, 35
    places = run(substrings._shared_anchors(1), run(substrings._send_anchors(length, span, 1), docs))
    texts = pa.RecordBatch.from_pydict({"bucket": pa.array([0] * len(rows), pa.int32()), "kind": pa.array([1] * len(rows), pa.int32()), "blob": pa.nulls(len(rows), pa.binary()), "doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    windows = run(substrings._send_windows(length, span, 1), [*places, texts])
    spans = np.concatenate([np.frombuffer(x.as_buffer(), substrings.SPAN) for b in run(substrings._repeats(length, span, 1), windows) for x in b.column(2)])
    for i, _ in rows:
        assert sum(y - x for x, y in substrings.covered(spans[spans["doc"] == i])) == want[i][1]


def test_equal_fingerprints_are_told_apart():
    import numpy as np

    words_ = np.array([[1, 5], [1, 6], [1, 5], [2, 5], [1, 6]], "<u8")
    order, group = substrings._equal_groups(words_, np.zeros(5, np.uint64))
    sets = {}
    for o, g in zip(order.tolist(), group.tolist(), strict=True):
        sets.setdefault(g, set()).add(o)
    assert sorted(map(sorted, sets.values())) == [[0, 2], [1, 4], [3]]


def test_cut_texts_keeps_characters_and_columns(spark):
    base = "漢字仮名交じり文" * 12
    docs = documents(spark, [(1, base), (2, "é" + base[3:] + "ü tail of its own"), (3, base), (4, "short")])
    out = substrings.cut_texts(spark, docs, 50)
    got = as_rows(out)
    assert out.columns == docs.columns and sorted(got) == [1, 2, 4]
    assert got[2].text.endswith("ü tail of its own") and got[2].text.startswith("é") and got[2].n_chars == len(got[2].text) < 30


def test_empty_table(spark):
    assert substrings.remove_repeats(spark, documents(spark, [])).collect() == []
    with pytest.raises(ValueError, match="16"):
        substrings.remove_repeats(spark, documents(spark, []), 15)


def test_repeated_rows(spark):
    text = "a text of more than fifty bytes, which stands in its table twice"
    got = substrings.remove_repeats(spark, documents(spark, [(5, text), (5, text), (7, text)]).coalesce(1), 50).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(5, 0), (5, 0), (7, len(text))]


def test_a_shared_passage_sends_few_records():
    """However many documents of a task hold a passage, each of its anchors goes out once, and its inner windows once."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    passage = " ".join(words(rng, 60))
    length, span = 50, 35
    inner = len(substrings.anchor_runs(passage.encode(), length, span)[0])
    sent = {}
    for n in (20, 200):
        rows = [(i, f"{i}{passage}") for i in range(n)]
        docs = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
        out = list(substrings._send_anchors(length, span, 1)(iter([docs])))
        anchors = sum(len(x.as_buffer()) // substrings.ANCHOR.itemsize for b in out for x, k in zip(b.column(2), b.column(1).to_pylist(), strict=True) if k == 0)
        places = list(substrings._shared_anchors(1)(iter(out)))
        texts = pa.RecordBatch.from_pydict({"bucket": pa.array([0] * n, pa.int32()), "kind": pa.array([1] * n, pa.int32()), "blob": pa.nulls(n, pa.binary()), "doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
        out = list(substrings._send_windows(length, span, 1)(iter([*places, texts])))
        passed = []
        windows = substrings._blobs(iter(out), substrings._window_dtype(length, span), passed, squeezed=True)
        sent[n] = anchors, len(windows)
        spans = np.concatenate([np.frombuffer(x.as_buffer(), substrings.SPAN) for b in passed for x in b.column(2)])
        assert len(np.unique(spans["doc"])) == n - 1 and 0 not in spans["doc"]
    # Only the anchors that cover the number in front differ from document to document.
    assert sent[200][0] - sent[20][0] <= 3 * 180 and sent[200][1] - sent[20][1] <= 3 * 180
    assert sent[200][0] < 200 * inner / 4
