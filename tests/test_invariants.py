"""What must hold for any blob: never larger, the same again, folded once only, and no blob breaks another's."""

import random

import pytest

from densefold.operators import columnar
from densefold.plans.compress import compress

SCHEMA = "blob_id long, kind string, tool_name string, command string, output string"
TOOLS = ["ls", "ps", "bash", "grep", "read", "", None]
COMMANDS = ["ls -lah /usr/bin", "ps aux", "git log --pretty=a|b|c", "cat x", "echo", "", None]
POOL = "abcXYZ 0129 \t\n:/|=.-_[]{}\",é→\x1b\r 　"


def blobs(seed: int, n: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = "".join(rng.choices(POOL, k=rng.randint(0, 6000)))
        elif kind == 1:
            text = "\n".join(rng.choice(["same line", "other", "", "x  "]) for _ in range(rng.randint(100, 900)))
        elif kind == 2:
            text = "[" + ",".join('{"a":%d,"b":"%s"}' % (k, rng.choice(["x", 'q\\"', ",", "é"])) for k in range(rng.randint(1, 300))) + "]"
        elif kind == 3:
            text = "total 5\n" * rng.randint(0, 1) + "\n".join(f"-rw {rng.randint(1, 3)} root  staff {k}K Jan {k % 28} 12:00 n {k}" for k in range(rng.randint(0, 90)))
        elif kind == 4:
            text = "\n".join(f"{rng.getrandbits(80):020x}|{rng.choice(['Ann', 'Bob Lee'])}|a@b|2024|{rng.choice(['', 'x|y', 'fix'])}" for _ in range(rng.randint(0, 120)))
        else:
            text = '{"k":%s,"é":[%s]}' % ("[" * rng.randint(0, 40), ",".join('{"v":%d}' % k for k in range(rng.randint(0, 400))))
        out.append((i, "after_tool_call", rng.choice(TOOLS), rng.choice(COMMANDS), text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_blob(spark, seed):
    df = spark.createDataFrame(blobs(seed), SCHEMA)
    once = {r.blob_id: r for r in compress(df).collect()}
    again = {r.blob_id: r for r in compress(df.repartition(5)).collect()}
    assert once == again and len(once) == 300
    for r in once.values():
        if r.action == "replace":
            assert len(r.result.encode()) + 256 <= len(r.output.encode()) and r.result.startswith("[@dense/1 ")
        else:
            assert r.result == r.output and r.label is None
    wins = spark.createDataFrame([(r.blob_id, r.kind, r.tool_name, r.command, r.result) for r in once.values() if r.action == "replace"], SCHEMA)
    assert wins.count() > 20
    assert {r.action for r in compress(wins).collect()} == {"continue"}


def test_listings_unfold_field_by_field(spark):
    rows = [r for r in blobs(3, 900) if r[0] % 6 == 4 and len(r[4].split("\n")) >= 4]
    df = spark.createDataFrame([(r[0], r[4], "git_log") for r in rows], "blob_id long, output string, layout string")
    got = columnar.unfold(columnar.fold(df, "output", "layout", "folded"), "folded", "back").where("folded IS NOT NULL").collect()
    assert len(got) > 50
    for r in got:
        lines = r.back.split("\n")
        assert [x.rstrip("|") for x in lines] == [x.rstrip("|") for x in r.output.split("\n")]


def test_unfold_takes_anything(spark):
    rng = random.Random(5)
    texts = ["", "x", "@dense/1.cols", "@dense/1.cols a=1 b", "@dense/1.dict", "@dense/1.dict a A\n@dense/1.cols a b\nA x", "@dense/1.delim \n@dense/1.cols|a|b\nq|r", "@dense/1.delim |\n@dense/1.cols|a|b", None]
    texts += ["".join(rng.choices(["@dense/1.cols", "@dense/1.dict", "@dense/1.delim", " ", "|", "a", "=", "A=1", "\n"], k=rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert len(columnar.unfold(df, "t", "u").collect()) == len(texts)
