import random

import numpy as np
import public_tokenizers
import pytest
from helpers import as_rows, documents, near_copies
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from densefold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def check(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    for e in (bpe.own_encoder(PATH), bpe.whole_encoder(PATH)):
        assert ids(e.encode(text)) == want, repr(text)
    assert bpe.vocabulary(PATH).piece_ids(text) == want
    assert bpe.vocabulary(PATH).decode(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


def test_every_character(library):
    for start in range(0, 0x110000, 4999):
        chars = [chr(c) for c in range(start, min(start + 4999, 0x110000)) if not 0xD800 <= c < 0xE000]
        check(library, "a".join(chars[:400]) + " " + " ".join(chars) + "1" + "1".join(chars[-400:]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "!", "...", "<|endoftext|>", "\r\n", "　", "\xa0", "\x1c", "漢", "😀", "ing", " the", "́"]) | st.text(max_size=4), max_size=14).map("".join))
def test_mixtures(library, text):
    check(library, text)


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 3000, "xyz123" * 3000, "é" * 2000, " " * 3000, "\n" * 999 + "x", " leading", "trailing "])
def test_awkward(library, text):
    check(library, text)


def test_own_merges_equal_compiled(library):
    """The list and the heap that serve vocabularies without compiled merges."""
    v = bpe.vocabulary(PATH)
    rng = random.Random(2)
    for _ in range(300):
        b = "".join(rng.choices("abcdeilnorstuh éü", k=rng.randint(1, 60))).encode()
        start = [v.byte_id[x] for x in b]
        want = v.core.encode_single_piece(b)
        assert v._merge_plain(list(start)) == want and v._merge_heap(list(start)) == want


def test_cuts_are_forced():
    """No token holds two bytes between which a fragment ends."""
    v = bpe.vocabulary(PATH)
    pairs = {t[i : i + 2] for t in v.bytes.values() for i in range(len(t) - 1)} - {b"<|", b"|>"}
    parts = v.fragments("xq漢zj\x00ß".encode())
    assert b"".join(parts) == "xq漢zj\x00ß".encode() and len(parts) > 1
    assert all(a[-1:] + b[:1] not in pairs for a, b in zip(parts, parts[1:], strict=False))


def test_documents(spark, library):
    rows = near_copies()
    docs = documents(spark, rows)
    got = as_rows(bpe.round_trip(docs, PATH))
    back = as_rows(bpe.decode(bpe.encode(docs, PATH), PATH))
    for i, t in rows:
        assert ids(got[i].ids) == library.encode(t or "", add_special_tokens=False).ids
        assert got[i].decoded == back[i].decoded == (t or "")
    assert bpe.round_trip(documents(spark, []), PATH).collect() == []


def test_broken_bytes_decode_as_replacement():
    v = bpe.vocabulary(PATH)
    assert v.decode(np.array([v.byte_id[0xE6], v.byte_id[0x41]], "<u4").tobytes()) == "�A"
