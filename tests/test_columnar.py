"""Fold and unfold of listings: limits, encodings, round trips, and texts that don't fit."""

import random

import pytest

from densefold import model
from densefold.operators import columnar

GIT = model.GIT_LOG


def fold(spark, texts, label="git_log"):
    df = spark.createDataFrame([(i, t, label) for i, t in enumerate(texts)], "i int, t string, l string")
    df = columnar.unfold(columnar.fold(df, "t", "l", "f"), "f", "u")
    rows = {r.i: r for r in df.collect()}
    return [(rows[i].f, rows[i].u) for i in range(len(texts))]


def listing(n, tail="subject", author="Ann Lee", mail=lambda i: "ann@example.org"):
    return "\n".join(f"{i:040x}|{author}|{mail(i)}|2024-01-{i % 28 + 1:02d}|{tail}" for i in range(n))


def test_rows_and_round_trip(spark):
    texts = [listing(30), listing(3), listing(4), "", "a|b", listing(5) + "\n\n" + listing(5), listing(30, tail="a|b  c "), None]
    out = fold(spark, texts)
    for k in (0, 2, 6):
        assert out[k][1] == texts[k] and len(out[k][0].encode()) < len(texts[k].encode())
    for k in (1, 3, 4, 5, 7):
        assert out[k] == (None, None)
    assert f"{model.MARK_COLS}|sha|author=Ann Lee|email=ann@example.org|date|subject" in out[0][0]


@pytest.mark.parametrize(("n", "coded"), [(61, True), (62, True), (63, False), (100, False)])
def test_code_limit(spark, n, coded):
    ((folded, back),) = fold(spark, [listing(400, mail=lambda i: f"person{i % n:03d}@example.org")])
    assert (f"{model.MARK_DICT}|email" in folded) is coded
    assert back == listing(400, mail=lambda i: f"person{i % n:03d}@example.org")


def test_empty_tails_decode(spark):
    """A tail that is empty is left out by the fold together with its separator; unfold takes such rows too."""
    t = "\n".join(f"{i:040x}|Ann Lee|ann@example.org|2024-01-01|{'x' if i % 2 else ''}" for i in range(20))
    ((folded, back),) = fold(spark, [t])
    assert folded is not None and back == "\n".join(x.rstrip("|") for x in t.split("\n"))


def test_provenance_line_is_dropped(spark):
    ((folded, _),) = fold(spark, [listing(30)])
    df = spark.createDataFrame([(f"[{model.VERSION} 9→8 bytes (-1%)]\n{folded}",), ("no fold here",)], "f string")
    assert [r.u for r in columnar.unfold(df, "f", "u").collect()] == [listing(30), None]


def test_blank_delimited(spark):
    rows = [f"-rw-r--r--   1 root  staff {10 + i}K Jan {i % 28 + 1} 12:0{i % 5} name  {i}" for i in range(40)]
    ((folded, back),) = fold(spark, ["total 9G\n" + "\n".join(rows)], "ls")
    assert folded.startswith("total 9G\n")
    assert back.split("\n")[1] == "-rw-r--r-- 1 root staff 10K Jan 1 12:00 name  0" and len(back.split("\n")) == 41


def test_random_listings(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcXYZ019é", k=rng.randint(1, 9)))
    texts = []
    for _ in range(60):
        low = [word() for _ in range(3)]
        texts.append("\n".join("|".join([word(), rng.choice(low), low[0], rng.choice(low + [word() + " x"]), word()]) for _ in range(rng.randint(4, 43))))
    for t, (folded, back) in zip(texts, fold(spark, texts), strict=True):
        if folded is not None:
            assert len(folded.encode()) < len(t.encode()) and back == t


def test_register_adds_a_layout(spark):
    x = model.Layout("csvlog", ("a", "b"), "rest", delim=";", programs=("csvlog",))
    model.register(x)
    try:
        t = "\n".join(f"constant-value;other-constant;{i}" for i in range(9))
        assert fold(spark, [t], "csvlog")[0][1] == t
    finally:
        del model._registry["csvlog"]
    for bad in ("::", "\t", " ", "A", "7", "=", "@", ""):
        with pytest.raises(ValueError, match="delimiter"):
            model.register(model.Layout("x", ("a",), "t", delim=bad))
    for cols in (("a b",), ("a=",), ("a;b",), ("",)):
        with pytest.raises(ValueError, match="names"):
            model.register(model.Layout("x", cols, "t", delim=";"))
    with pytest.raises(ValueError, match="column"):
        model.register(model.Layout("x", (), "t"))


@pytest.mark.parametrize("delim", list(";,:|#!^~%&*+-/<>?$(") + ["\\", "\u00a6"])
def test_every_delimiter_unfolds(spark, delim):
    model.register(model.Layout("own", ("a", "b", "c"), "rest", delim=delim, programs=("own",)))
    try:
        t = "\n".join(delim.join(["same value here", f"{'one two' if i % 2 else 'three four'}", str(i), f"tail{delim}{i}"]) for i in range(30))
        ((folded, back),) = fold(spark, [t], "own")
        assert folded is not None and back == t
    finally:
        del model._registry["own"]


def test_process_listing(spark):
    head = "USER       PID %CPU %MEM    VSZ   RSS TTY      STAT START   TIME COMMAND"
    rows = [f"{'root' if i % 2 else 'daemon'}  {100 + i}  0.0  0.1 {2000 + i} 10 ?  Ss  Jan01  0:0{i % 3} /sbin/init  --x {i}" for i in range(40)]
    ((folded, back),) = fold(spark, [head + "\n" + "\n".join(rows)], "ps")
    assert folded.startswith(head + "\n") and "USER A=daemon B=root" in folded and "%CPU=0.0" in folded
    assert back.split("\n")[0] == head and back.split("\n")[1] == "daemon 100 0.0 0.1 2000 10 ? Ss Jan01 0:00 /sbin/init  --x 0"
