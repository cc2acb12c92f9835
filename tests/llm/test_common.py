import random

import pytest
from helpers import union

from densefold.llm.common import Scratch, components, shared_dir


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)] + [(7, 7), (5, 6), (6, 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.component for r in components(Scratch(spark, "test"), df, "c").collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert all(want[i] == c for i, c in got.items())
    assert {i for p in pairs if p[0] != p[1] for i in p} == set(got)


def test_no_links(spark):
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "c").collect() == []


def test_shared_folder_is_that_of_the_session(spark):
    assert Scratch(spark, "x").path.startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
