"""The queries over the driver's tables: the rows of their SQL, or of a plain version."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import DATA, compare, connect
from tokenizers import Tokenizer

from densefold.llm import fingerprints, queries
from test_fingerprints import plain_fingerprint, plain_likeness, plain_text
from test_licenses import plain_scan

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_op2(spark, docs, ids):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op2_bpe_round_trip")}
    assert got == {i: (len(x), hashlib.sha256(packed(x)).hexdigest(), hashlib.sha256(docs[i].encode()).hexdigest()) for i, x in ids.items()}


def test_op3(spark, docs):
    got = {r.doc_id: (r.n_sentences, r.sentences, r.n_licenses, r.licenses) for r in rows(spark, "op3_license_scan")}
    want = {i: plain_scan(t) for i, t in docs.items()}
    assert got == {i: (n, ",".join(s), len(x), ",".join(x)) for i, (n, s, x) in want.items()}


def test_op4(spark, docs):
    got = rows(spark, "op4_language_id")
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op5(spark, ids):
    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op5_token_files")}, 0
    for i in sorted(ids):
        assert got[i] == (start, len(ids[i]) + 1, zlib.crc32(packed([*ids[i], 0])))
        start += len(ids[i]) + 1


def test_op8(spark, ids):
    by, sequences = {}, {}
    for r in rows(spark, "op8_best_fit_packing"):
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        parts, at = sorted(by[i], key=lambda r: r.piece), 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(packed([*x, 2][at : at + r.length])) == r.ids_crc32
            at += r.length
        assert at == len(x) + 1
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(len(x) + 1 for x in ids.values()) / 1024 + 2


def test_op10(spark, docs):
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in rows(spark, "op10_fingerprints")}
    sql = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
     e AS (SELECT *, coalesce(lag(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d)
     SELECT doc_id, n, sha256(left(t, n - n // 2) || left(f, n // 2)) FROM e"""
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == {i: (n, h) for i, n, h in connect(SF).execute(sql).fetchall()}
    plain = {i: plain_fingerprint(t) for i, t in docs.items()}
    for k, i in enumerate(order):
        following = order[(k + 1) % len(order)]
        changed = plain_fingerprint(fingerprints.edited(docs[i], docs[following]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_text(plain[i]), plain_text(changed))
        for near, other in ((got[i].near_edited, changed), (got[i].near_next, plain[following])):
            want = plain_likeness(plain[i], other)
            assert want is None or near == want
    long = [r for r in got.values() if r.n_chars >= 200]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.99 * len(long)
