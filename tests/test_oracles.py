"""Every query of the engine gives the rows that its SQL gives."""

import pytest
from oracle import DATA, compare

from densefold.queries import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001") > 0
