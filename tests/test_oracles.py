"""Every query of the catalog gives exactly what its SQL gives in DuckDB, from a sound plan."""

from __future__ import annotations

import pytest

from oracles import ORACLES
from tests.compare import connect, differences
from triplens.plans.catalog import QUERIES

# No plan may pair all rows of two sides, or hand rows to Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    _, bad = differences(df, duck, ORACLES[name])
    assert not bad, bad[:3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_the_derived_trips_have_something_for_every_check(spark, folder):
    """Queries that would agree on nothing prove nothing."""
    for name in ("orphan_by_payment", "airport_fee_amounts"):
        assert QUERIES[name](spark, folder).count() > 0, name
    assert QUERIES["orphan_negatives"](spark, folder).first().orphans > 0
    assert QUERIES["near_dups_simple"](spark, folder).count() > QUERIES["near_dups_strict"](spark, folder).count()
