import random
import zlib
from collections import defaultdict

import public_tokenizers
from helpers import near_copies, plain_bayes, plain_components, plain_removed, words
from tokenizers import Tokenizer

import corpus_pipeline
from densefold.llm import langid, queries


def write(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "src", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")


def cut(text, gone):
    """Without the characters all of whose bytes are gone in one run; those cut in part stay."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not all(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def test_same_as_plain_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = near_copies()
    passage = " ".join(words(rng, 60))
    rows += [(10000 + i, f"{' '.join(words(rng, 40))} {passage} {' '.join(words(rng, 40))}") for i in range(12)] + [(20000, passage), (20001, "12 !!")]
    write(spark, str(tmp_path), rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    lang = {i: "en" if i % 2 else "de" for i, _ in rows}
    found = plain_bayes([(t, lang[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2], [t for _, t in rows])
    kept = [(i, t) for (i, t), (pred, score) in zip(rows, found, strict=True) if pred != "und" and (pred == lang[i] or score < langid.SURE)]
    lettered = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert 50 < len(kept) < len(lettered)  # the model's decisions take effect
    _, comp = plain_components(kept, 5, 8, 10)
    kept = [(i, t) for i, t in kept if comp[i] == i]
    gone = plain_removed(kept, corpus_pipeline.PASSAGE)
    left = {i: s for i, t in kept if (s := cut(t, gone[i][3]))}
    t, by = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(int)
    for r in got:
        by[r.doc_id] += r.length
    assert dict(by) == {i: len(t.encode(s, add_special_tokens=False).ids) + 1 for i, s in left.items()}


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, str(tmp_path), near_copies()[:40])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert "pipeline" in queries.QUERIES


def test_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
