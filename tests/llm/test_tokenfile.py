import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import as_rows, documents, near_copies
from tokenizers import Tokenizer

from densefold.llm import tokenfile
from densefold.llm.common import clean

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_files_hold_all_documents_in_order(spark):
    rows = near_copies()
    folder = tokenfile.write(spark, documents(spark, rows).repartition(4), PATH, end_id=0)
    read = tokenfile.read(spark, folder)
    got, digests = as_rows(read), as_rows(tokenfile.digests(read))
    t, start = Tokenizer.from_file(PATH), 0
    for i, text in sorted(rows):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert bytes(got[i].ids) == want and got[i].start == start
        assert (digests[i].start, digests[i].n_tokens, digests[i].ids_crc32) == (start, len(want) // 4, zlib.crc32(want))
        start += len(want) // 4
    some = as_rows(tokenfile.fetch(folder, tokenfile.index(spark, folder).where("doc_id % 3 = 0")))
    assert some and all(some[i].ids == got[i].ids for i in some)


def test_empty_table(spark):
    folder = tokenfile.write(spark, documents(spark, []), PATH, end_id=0)
    assert tokenfile.read(spark, folder).collect() == []


def test_a_folder_of_ones_own_stays(spark, tmp_path):
    """Repeated rows are records of their own, and what was written outlives the steps of the session."""
    folder = tokenfile.write(spark, documents(spark, [(3, "abc"), (1, "x y"), (3, "abc"), (2, None)]), PATH, end_id=0, folder=f"{tmp_path}/tokens")
    clean(spark)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in tokenfile.digests(tokenfile.read(spark, folder)).collect())
    assert [r[0] for r in got] == [1, 2, 3, 3] and [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(4)]
    assert (tmp_path / "tokens" / "index").is_dir() and list((tmp_path / "tokens").glob("*.rec"))


def test_damage_is_found():
    data = b"".join(map(tokenfile.frame, [b"", b"abc", b"x" * 100]))
    assert [p for _, p in tokenfile.records(io.BytesIO(data))] == [b"", b"abc", b"x" * 100]
    for broken in (data[:-1], data[:5], data[:40] + b"?" + data[41:], b"\1" + data[1:]):
        with pytest.raises(ValueError, match="record at"):
            list(tokenfile.records(io.BytesIO(broken)))
