"""Framed messages: reading, writing, bad frames, and what sessions are answered with."""

import io
import json

import pytest

from densefold.plans import session
from densefold.sources import frames

BIG = "a\n" * 3000


def msg(**m) -> bytes:
    return frames.frame(json.dumps(m, ensure_ascii=False))


def hook(i, output, kind="after_tool_call"):
    return msg(jsonrpc="2.0", id=i, method="hook.handle", params={"kind": kind, "tool_name": "read", "tool_input": {"command": "x"}, "tool_output": output})


def parse(data, **kw):
    return list(frames.bodies(io.BytesIO(data), **kw))


def test_frames():
    assert parse(b"") == []
    assert parse(b"content-LENGTH: 2\nX: y\n\n{}" + frames.frame("é")) == [(b"{}", None), ("é".encode(), None)]
    assert parse(b"X: y\r\n\r\n" + frames.frame("1")) == [(None, "missing Content-Length"), (b"1", None)]
    assert parse(b"Content-Length: x\r\n\r\n") == [(None, "missing Content-Length")]
    assert parse(frames.frame("12345") + frames.frame("1"), max_bytes=4) == [(None, "frame too large: 5 > 4"), (b"1", None)]
    assert parse(b"Content-Length: 9\r\n\r\nshort") == [(None, "frame cut short")]
    assert parse(frames.frame("x" * 3_000_000) + frames.frame("2"))[1] == (b"2", None)


def test_messages():
    assert frames.message(b'{"id":"a","method":"m","params":{"b":1}}', None) == ('"a"', "m", '{"b":1}', None)
    assert frames.message(b"[1]", None) == ("null", "", None, None)
    assert frames.message(b"{", None)[3] == "bad JSON: JSONDecodeError"
    assert frames.message(None, "why") == (None, None, None, "why")


@pytest.fixture
def folder(tmp_path):
    one = msg(id=1, method="initialize") + msg(id=9, method="command.invoke", params={"command": "densefold"}) + hook(2, BIG) + b"Foo: x\r\n\r\n" + hook("x", 5) + hook(3, BIG, "before")
    one += msg(id=4, method="command.invoke", params={"command": "/densefold", "request_id": 'r"1'}) + frames.frame("{bad") + msg(id=5, method="command.invoke", params={"command": "zzz"}) + msg(id=6, method="shutdown") + hook(7, BIG)
    (tmp_path / "one.frames").write_bytes(one)
    (tmp_path / "two.frames").write_bytes(frames.frame("{}") + msg(id=None, method="info.get") + b"Content-Length: 900\r\n\r\nshort")
    (tmp_path / "three.txt").write_bytes(b"no frames")
    return str(tmp_path)


def test_sessions(spark, folder):
    got = {}
    for r in session.answers(frames.read(spark, folder)).orderBy("session", "frame_no", "part").collect():
        got.setdefault((r.session, r.frame_no), []).append(json.loads(r.body))
    assert set(got) == {("one", k) for k in (0, 1, 2, 4, 5, 6, 8, 9)} | {("two", 0), ("two", 1)}
    assert got["one", 0][0]["result"] == {"protocol_version": 1, "capabilities": {}}
    assert got["one", 1][0]["params"]["event"]["content"] == "densefold — no compressions yet"
    assert got["one", 2][0]["result"]["action"] == "replace" and got["one", 2][0]["id"] == 2
    assert got["one", 4][0] == {"jsonrpc": "2.0", "id": "x", "result": {"action": "continue"}} and got["one", 5][0]["result"]["action"] == "continue"
    system, done, answer = got["one", 6]
    assert system["params"]["request_id"] == 'r"1' and "saved across 1 tool call  (99% avg reduction)" in system["params"]["event"]["content"]
    assert done["params"]["event"] == {"kind": "done"} and answer["result"] == {"ok": True} and answer["id"] == 4
    assert "unknown command 'zzz'" in got["one", 8][0]["params"]["event"]["content"]
    assert got["two", 0][0] == {"jsonrpc": "2.0", "id": None, "result": {}}


def test_answers_are_written_as_frames(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    frames.write(spark, session.answers(frames.read(spark, folder)).orderBy("session", "frame_no", "part"), out)
    back = frames.read(spark, out)
    assert back.count() == 16 and back.where("error IS NOT NULL").count() == 0


def test_bad_frames_are_told(spark, folder):
    lines = {(r.session, r.frame_no): r.line for r in session.log(frames.read(spark, folder)).collect()}
    assert lines == {("one", 3): "bad frame: missing Content-Length; going on with the next one", ("one", 7): "bad frame: bad JSON: JSONDecodeError; going on with the next one", ("two", 2): "bad frame: frame cut short; going on with the next one"}


def test_reports_count_what_was_before_them(spark):
    """Many reports in one session, over wins of two labels: each as of its place."""
    wins = spark.createDataFrame([("s", k, "ls" if k % 3 else "text", 1000 * k, 100) for k in range(1, 60, 2)] + [("t", 5, "ls", 10, 1)], "session string, frame_no long, label string, in_bytes long, out_bytes long")
    asked = spark.createDataFrame([("s", k) for k in range(0, 62, 2)] + [("u", 1)], "session string, frame_no long")
    got = {(r.session, r.frame_no): r.report for r in session.reports(wins, asked).collect()}
    assert set(got) == {("s", k) for k in range(2, 62, 2)}
    for (_, k), text in got.items():
        before = [j for j in range(1, 60, 2) if j < k]
        assert f"saved across {len(before)} tool call{'s' if len(before) > 1 else ''} " in text
        assert text.count("\n") == 2 + len({bool(j % 3) for j in before})
        assert text.split("\n")[3:] == sorted(text.split("\n")[3:], key=lambda x: -int(sum(1000 * j - 100 for j in before if (j % 3 > 0) == x.strip().startswith("ls"))))


def test_empty_folder(spark, tmp_path):
    assert session.answers(frames.read(spark, str(tmp_path))).collect() == []
