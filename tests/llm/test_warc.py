import gzip
import hashlib
import io
import tracemalloc
import zlib

import pytest
from oracle import DATA, compare
from pyspark.sql import functions as F

from densefold.llm import queries, warc

SCHEMA = "page_id long, url string, html string, holder string, digest string, record_id string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], SCHEMA)


def test_query_gives_the_rows_of_its_sql(spark):
    assert compare(spark, queries.op7_warc, queries.ORACLES["op7_warc"], f"{DATA}/sf0.001") > 0


def test_revisits_and_awkward_payloads(spark):
    big, odd = "p" * 1000, "é漢\r\n\r\n" * 3000
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (2, "u", "p" * 999), (4, "u", "p" * 999), (6, "u", None), (7, "u", ""), (8, "http://ü/", odd), (9, "v", odd + "x")]
    rows += [(100 + i, "h", "q" * 2000) for i in range(50)]
    read = warc.archive_and_read(spark, pages(spark, rows).repartition(3))
    got = {r.page_id: r for r in read.collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, h in rows:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_sha1) == (len(b), hashlib.sha1(b).hexdigest())
        assert got[i].payload is None if got[i].warc_type == "revisit" else bytes(got[i].payload) == b
    holder = {i: r.refers_to for i, r in got.items() if r.warc_type == "revisit"}
    assert holder == {1: 5, 3: 5} | {100 + i: 149 for i in range(49)}
    assert got[3].target_uri is None and got[5].target_uri == "http://b/%0D%0AX: y"


def test_empty_table(spark):
    assert warc.archive_and_read(spark, pages(spark, [])).collect() == []


@pytest.fixture
def folder(spark, tmp_path):
    warc.register(spark)
    recs = [warc.record(f"urn:x:{i}", "revisit" if i % 3 == 0 else "response", f"http://h/{i}", b"body %d " % i * 3000, f"urn:x:{i + 1}") for i in range(9)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "own.warc.gz").write_bytes(b"".join(map(warc.member, recs[:3])))
    (tmp_path / "plain.warc").write_bytes(info + b"".join(recs[3:6]))
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(map(gzip.compress, recs[6:])))
    return str(tmp_path)


def test_reads_archives_of_other_writers(spark, folder):
    got = {r.record_id: r for r in spark.read.format("warc").load(folder).collect()}
    assert len(got) == 10 and bytes(got[None].payload) == b"hello"
    for i in range(9):
        r = got[f"urn:x:{i}"]
        assert r.payload_bytes == len(b"body %d " % i * 3000) and (r.payload is None) == (i % 3 == 0)


def in_pieces(data, n):
    """Gzip members that are cut anywhere."""
    return b"".join(gzip.compress(data[k : k + n]) for k in range(0, len(data), n))


RECORDS = [warc.record(f"urn:{k}", "revisit" if k == 3 else "response", f"http://h/{k}", b"%d-payload " % k * (1 + 40_000 * (k % 3)), "urn:0") for k in range(8)]
FORMS = {
    "own": b"".join(map(warc.member, RECORDS)), "plain": b"".join(RECORDS), "member_each": b"".join(map(gzip.compress, RECORDS)), "one_stream": gzip.compress(b"".join(RECORDS)),
    "pieces": in_pieces(b"".join(RECORDS), 70_001), "tiny_pieces": in_pieces(b"".join(RECORDS)[:3000], 17) + in_pieces(b"".join(RECORDS)[3000:], 90_000),
    "stream_then_own": gzip.compress(b"".join(RECORDS[:5])) + b"".join(map(warc.member, RECORDS[5:])), "own_then_stream": b"".join(map(warc.member, RECORDS[:5])) + gzip.compress(b"".join(RECORDS[5:])),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("read", [1 << 20, 50])
def test_no_record_is_lost(form, read, monkeypatch):
    """All records, some, and none, of archives of every form, with large and with tiny buffers."""
    monkeypatch.setattr(warc, "READ", read)
    monkeypatch.setattr(warc, "INFLATED", max(read >> 4, 100))
    want = [(f"<urn:{k}>", r.split(b"\r\n\r\n", 1)[1][:-4]) for k, r in enumerate(RECORDS)]
    for chosen in (range(8), [0, 4], [7], []):
        names = {f"<urn:{k}>" for k in chosen}
        got = [(f["warc-record-id"], b) for f, b in warc.records(io.BytesIO(FORMS[form]), lambda f, names=names: f["warc-record-id"] in names)]
        assert got == [want[k] for k in chosen]
    heads = [f["warc-record-id"] for f, b in warc.records(io.BytesIO(FORMS[form]), lambda f: True, with_payload=False)]
    assert heads == [i for i, _ in want]


def test_unwanted_payloads_are_not_held():
    """Of a stream of 200 MB inflated, in one member, no more than small buffers are held, and so with payloads left out."""
    big = warc.record("urn:big", "response", "u", b"x" * (100 << 20))
    data = gzip.compress(big + big + warc.record("urn:small", "response", "u", b"y"), 1)
    del big
    for wanted, with_payload, n in ((lambda f: f["warc-record-id"] == "<urn:small>", True, 1), (lambda f: True, False, 3)):
        tracemalloc.start()
        assert len([f for f, _ in warc.records(io.BytesIO(data), wanted, with_payload)]) == n
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20


def test_archives_cut_short():
    for form in ("plain", "member_each", "one_stream"):
        with pytest.raises((ValueError, EOFError, zlib.error)):
            list(warc.records(io.BytesIO(FORMS[form][:-100]), lambda f: True))


def test_digests_and_sizes_of_other_writers(spark, tmp_path):
    """Digests in hexadecimal, or of another kind; sizes with payloads left out are those with them."""
    sha = hashlib.sha1(b"p" * 9000).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"p" * 9000
    recs = [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a%d>\r\nWARC-Payload-Digest: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (k, d, len(http)) + http + b"\r\n\r\n" for k, d in enumerate([b"SHA1:" + sha.encode(), b"md5:abc", b"sha1:no!"])]
    recs.append(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: 70000\r\n\r\n" + b"z" * 70000 + b"\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(recs)))
    warc.register(spark)
    for payload in ("true", "false"):
        got = {r.record_id: r for r in spark.read.format("warc").option("payload", payload).load(str(tmp_path)).collect()}
        assert {i: (r.payload_sha1, r.payload_bytes) for i, r in got.items()} == {"a0": (sha, 9000), "a1": (None, 9000), "a2": (None, 9000), "r": (None, 70000)}


def test_a_payload_past_all_buffers(spark):
    big = "long payload \u00e9 " * 400_000
    read = warc.archive_and_read(spark, pages(spark, [(1, "u", big), (2, "u", big + "x")]))
    got = {r.page_id: r for r in read.collect()}
    assert all(bytes(got[i].payload) == t.encode() and got[i].payload_sha1 == hashlib.sha1(t.encode()).hexdigest() for i, t in ((1, big), (2, big + "x")))


def test_predicates_are_pushed_down(spark, folder):
    df = spark.read.format("warc").load(folder)
    one = df.where((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://h/4"))
    assert [r.record_id for r in one.collect()] == ["urn:x:4"]
    reader = warc.WarcReader({"path": folder}, df.schema)
    rest = list(reader.pushFilters([warc.EqualTo(("warc_type",), "response"), warc.In(("record_id",), ("urn:x:1",)), warc.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in rest] == [("payload_bytes",)] and len(reader.tests) == 2
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    assert df.where(F.col("record_id").isin("urn:x:1", "urn:x:7", "none")).count() == 2
    assert df.where("payload_bytes > 10 AND warc_type = 'warcinfo'").count() == 0
    assert {r.payload for r in spark.read.format("warc").option("payload", "false").load(folder).select("payload").collect()} == {None}


def test_unwanted_payloads_are_not_decoded():
    """A record whose payload is damaged is no trouble as long as nobody asks for it."""
    good, bad = (warc.member(warc.record(f"urn:{k}", "response", "u", k.encode() * 90000)) for k in "ab")
    bad = bad[:-200] + b"\0" * 200
    stream = io.BytesIO(bad + good)
    assert [f["warc-record-id"] for f, _ in warc.records(stream, lambda f: f["warc-record-id"] == "<urn:a>")] == ["<urn:a>"]
    with pytest.raises(Exception, match="Error|error|invalid"):
        list(warc.records(io.BytesIO(bad), lambda f: True))


def test_wrong_digest_is_an_error():
    reader = warc.WarcReader({"path": "x"}, warc.WarcSource({}).schema() and __import__("pyspark.sql.types", fromlist=["x"]).StructType())
    data = warc.record("urn:1", "response", "u", b"payload").replace(b"\r\n\r\npayload", b"\r\n\r\npayloaD")
    ((fields, block),) = warc.records(io.BytesIO(data), lambda f: True)
    with pytest.raises(ValueError, match="digest"):
        reader._row(fields, block)


def test_repeated_rows(spark):
    big = "p" * 1000
    read = warc.archive_and_read(spark, pages(spark, [(1, "u", big), (1, "u", big), (5, "u", big), (5, "u", big), (1, "u", "q" * 1000)]))
    assert sorted((r.page_id, r.warc_type, r.refers_to) for r in read.select("page_id", "warc_type", "refers_to").collect()) == [(1, "response", None), (1, "revisit", 5), (1, "revisit", 5), (5, "response", None), (5, "response", None)]
