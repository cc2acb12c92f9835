import zlib

import pytest
from helpers import as_rows, documents, plain_bayes
from oracle import DATA

from densefold.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got, lang = as_rows(langid.identify(spark, docs)), {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(lang) and 0.15 < len(held) / len(got) < 0.35
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.97


def test_awkward_texts_and_missing_labels(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der hund und die katze", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !!", None), (203, "the dog", None), (204, "und die katze " * 20000, None)]
    got = as_rows(langid.identify(spark, documents(spark, rows)))
    assert {i: got[i].lang_pred for i in range(200, 205)} == {200: "und", 201: "und", 202: "und", 203: "en", 204: "de"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[200].score == 0
    kept = langid.keep_identified(spark, documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and {r.doc_id for r in kept.collect()} == set(got) - {200, 201, 202}
    assert {r.score for r in kept.collect()} == {"x"}


def test_nothing_to_learn_from(spark):
    assert langid.identify(spark, documents(spark, [])).collect() == []
    got = langid.identify(spark, documents(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert [r.lang_pred for r in got] == ["und", "und"]


def test_the_label_is_no_input(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der hund und die katze", "de") for i in range(30)]
    base = langid.train(spark, documents(spark, rows), langid.F.col("text"), langid.F.col("lang"))
    assert base.score(["the cat", "die katze", "7"]) [0] == ["en", "de", "und"]


def test_same_as_plain_bayes(spark):
    """Labels and scores of a naive Bayes of dictionaries, over texts of several languages, parts, repeats and kinds."""
    docs = [r for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(90).collect()]
    rows = [(r.doc_id, r.text[:1500], r.lang if r.doc_id % 7 else None) for r in docs]
    rows += [(9000, None, "en"), (9001, "", "fr"), (9002, "7 8", None), (9003, "x", None), (9004, "\u4e2d\u6587 \u01c5 \u0130", "zh"), (9004, "\u4e2d\u6587 \u01c5 \u0130", "zh"), (9005, "ab " * 30000, None)]
    learn = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark, documents(spark, rows).repartition(3)).collect())
    want = sorted((i, *p) for (i, _, _), p in zip(rows, plain_bayes(learn, [t for _, t, _ in rows]), strict=True))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)


def test_ties_go_to_the_first_label():
    counts = langid.np.ones((3, langid.BUCKETS + 1), langid.np.int64)
    model = langid.Model(["a", "b", "c"], counts)
    names, scores = model.score(["any text", "", None, "any text"])
    assert names == ["a", "und", "und", "a"] and scores == pytest.approx([1 / 3, 0, 0, 1 / 3])


def test_many_labels_are_scored_in_turn(monkeypatch):
    rng = langid.np.random.default_rng(1)
    model = langid.Model([f"l{k:02}" for k in range(40)], rng.integers(0, 50, (40, langid.BUCKETS + 1)))
    texts = ["some text", "another one here", None, "some text " * 500]
    once = model.score(texts)
    monkeypatch.setattr(langid, "LABELS", 7)
    assert model.score(texts)[0] == once[0] and model.score(texts)[1] == pytest.approx(once[1])


def test_the_model_decides_which_documents_stay(spark):
    """Documents that are declared as another language than they are written in go; unsure ones and undeclared ones stay."""
    rows = [(i, "the cat and the dog with this house", "en") for i in range(30)] + [(100 + i, "der hund und die katze auf dem haus", "de") for i in range(30)]
    rows += [(200, "the dog and this cat", "de"), (201, "die katze und der hund", "de"), (202, "die katze und der hund", None), (203, "q", "de"), (204, "die katze und der hund", "xx")]
    kept = {r.doc_id for r in langid.keep_identified(spark, documents(spark, rows)).collect()}
    assert kept == {i for i, _, _ in rows} - {200, 204}
    assert {r.doc_id for r in langid.keep_identified(spark, documents(spark, rows), sure=2.0).collect()} == {i for i, _, _ in rows}


def test_a_table_without_labels_keeps_its_documents(spark):
    rows = [(1, "some text", None), (2, None, None), (3, "12", None), (4, "\u6f22", None)]
    assert {r.doc_id for r in langid.keep_identified(spark, documents(spark, rows)).collect()} == {1, 4}
    assert langid.keep_identified(spark, documents(spark, [])).collect() == []


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    with pytest.raises(ValueError, match="labels"):
        langid.identify(spark, documents(spark, [(i, "x", f"l{i}") for i in range(20)]))


def test_parts_of_long_texts(monkeypatch):
    text = "The quick brown fox, 12 jumps over! the lazy dog " * 50
    whole = sorted(langid.features(text).tolist())
    monkeypatch.setattr(langid, "STEP", 7)
    assert sorted(langid.features(text).tolist()) == whole
