from __future__ import annotations

import pytest

from tests.compare import differences
from tests.llm.check import connect
from triplens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, con, name):
    n, bad = differences(QUERIES[name](spark, folder), con, ORACLES[name])
    assert n and not bad, bad[:3]


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))
