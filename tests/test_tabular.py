"""JSON folds: strictness, column order, quoting, and the nested search."""

import json

from densefold.operators import tabular
from densefold.operators.tabular import fold_nested_text


def fold(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: r.f for r in tabular.fold(df, "t", "f").collect()}
    return [rows[i] for i in range(len(texts))]


def test_top_level(spark):
    good = {
        '[{"host":"n1"},{"up":true,"host":"n2"},{"load":0.5,"up":false}]': "@dense/1.table 3 rows\nhost,up,load\nn1,,\nn2,true,\n,false,0.5",
        ' [{"b":"x,y","a":"q\\"r"},{"b":null,"a":true}] ': '@dense/1.table 2 rows\nb,a\n"x,y","q""r"\n,true',
        '[{"k":{"n":[1,2]}},{"k":""}]': '@dense/1.table 2 rows\nk\n"{""n"":[1,2]}"\n',
    }
    assert fold(spark, list(good)) == list(good.values())


def test_not_folded(spark):
    bad = ['[{"a":1}]', "[]", "[1,2]", '[{"a":1},2]', '[{"a":1},null]', '[{"a":1},{"a":2}] x', '[{"a":1},{"a":2}],[1]', "[{'a':1},{'a':2}]", '[{"a":NaN},{"a":1}]', '[{"a":1e400},{"a":1}]', "[{},{}]", "", "text", '{"a":1}', None]
    assert fold(spark, bad) == [None] * len(bad)


def test_nested_largest_wins():
    small, big = [{"a": 1}, {"a": 2}], [{"name": f"item{i}", "v": i} for i in range(4)]
    got = json.loads(fold_nested_text(json.dumps({"s": small, "deep": {"big": big}, "é": 1.5}, ensure_ascii=False)))
    assert got["s"] == small and got["é"] == 1.5
    assert got["deep"]["big"].startswith("@dense/1.table 4 rows\nname,v\nitem0,0")


def test_nested_limits():
    rows = [{"a": 1}, {"a": 2}]
    deep = lambda n: json.dumps({"k": rows} if n == 1 else {"k": json.loads(deep(n - 1))})
    assert fold_nested_text(deep(8)) is not None and fold_nested_text(deep(9)) is None
    assert fold_nested_text("[" * 200000) is None
    assert fold_nested_text('{"a":[{"b":NaN},{"b":1}]}') is None
    assert fold_nested_text('{"a":[{"b":"\\ud800"},{"b":1}]}') is None
    assert fold_nested_text('[{"items":[{"a":1},{"a":2}]}]') is None
    assert fold_nested_text('{"e":[{},{}]}') is None
    assert fold_nested_text(None) is None
