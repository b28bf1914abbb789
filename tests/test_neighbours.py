from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from tests.frames import later, make_trips
from triplens import schema as S
from triplens.operators.neighbours import (
    LEVELS,
    dispute_rows,
    levels_for,
    ordered_neighbours,
    refund_rows,
)

SCHEMA = T.StructType([T.StructField("trip_id", T.LongType()), T.StructField("v", T.IntegerType())])


def brute(rows):
    rows = sorted(rows)
    out = {}
    for i, (k, v) in enumerate(rows):
        before = rows[i - 1][1] if i else None
        after = rows[i + 1][1] if i + 1 < len(rows) else None
        out[k] = (v, before, after)
    return out


@pytest.mark.parametrize("levels", [(), (3,), (4, 6), (2, 3, 4), LEVELS])
@pytest.mark.parametrize("spread", [200, 5_000, 2**62])
def test_equals_a_walk_over_the_sorted_rows(spark, levels, spread):
    rng = random.Random(7)
    keys = {rng.randrange(-spread, spread) for _ in range(150)} | {-(2**63), 2**63 - 1}
    rows = [(k, rng.choice([None, 1, 2, 3])) for k in keys]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {
        r["trip_id"]: (r["v"], r["prev_v"], r["next_v"])
        for r in ordered_neighbours(df, ["v"], levels=levels).collect()
    }
    assert got == brute(rows)


def test_null_first_value_of_a_block_is_passed_on(spark):
    rows = [(6, 1), (7, 2), (8, None), (9, 3), (15, None), (16, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        r["trip_id"]: (r["v"], r["prev_v"], r["next_v"])
        for r in ordered_neighbours(df, ["v"], levels=(3, 2)).collect()
    }
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ordered_neighbours(df, ["v"]).count() == 0
    assert levels_for(df) == LEVELS[:1]


def test_text_key_is_refused(spark):
    with pytest.raises(TypeError):
        ordered_neighbours(spark.createDataFrame([("a", 1)], "trip_id string, v int"), ["v"])


def test_thin_keys_need_all_levels(spark):
    df = spark.createDataFrame([(0, 1), (2**62, 1)], SCHEMA)
    assert levels_for(df) == LEVELS
    assert levels_for(df.where("trip_id = 0")) == LEVELS[:1]


def brute_refunds(rows, cols):
    rows = sorted(rows, key=lambda r: r["trip_id"])
    for c in cols:
        kept = []
        for i, r in enumerate(rows):
            near = [rows[j][c] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
            if r[c] is not None and r[c] in near:
                kept.append(r)
        rows = kept
    return {r["trip_id"] for r in rows}


@pytest.mark.parametrize("levels", [None, (2, 3), (3,), ()])
def test_refunds_equal_a_walk(spark, levels):
    rng = random.Random(3)
    changes = [
        {
            S.PICKUP: later(minutes=rng.randrange(3)),
            S.DROPOFF: rng.choice([None, later(hours=1), later(hours=2)]),
            S.PU: rng.choice([1, 2, None]),
        }
        for _ in range(120)
    ]
    df = make_trips(spark, *changes)
    rows = [r.asDict() for r in df.collect()]
    got = {r[0] for r in refund_rows(df, levels=levels).collect()}
    assert got == brute_refunds(rows, (S.PICKUP, S.DROPOFF, S.PU))


def test_each_test_may_match_a_different_neighbour(spark):
    """Row 1 shares its pickup time with row 0 only and its dropoff and zone with row 2 only."""
    a, b = later(minutes=0), later(minutes=1)
    df = make_trips(
        spark,
        {S.PICKUP: a, S.DROPOFF: later(hours=1), S.PU: 5},
        {S.PICKUP: a, S.DROPOFF: later(hours=2), S.PU: 6},
        {S.PICKUP: b, S.DROPOFF: later(hours=2), S.PU: 6},
        {S.PICKUP: b, S.DROPOFF: later(hours=3), S.PU: 7},
    )
    assert sorted(r[0] for r in refund_rows(df).collect()) == [1, 2]


def test_neighbours_are_recomputed_after_each_test(spark):
    """Rows 0 and 2 only become neighbours once row 1 is gone."""
    a = later(minutes=0)
    df = make_trips(
        spark,
        {S.PICKUP: a, S.DROPOFF: later(hours=1), S.PU: 5},
        {S.PICKUP: a, S.DROPOFF: later(hours=1), S.PU: 5},
        {S.PICKUP: later(minutes=9), S.DROPOFF: later(hours=1), S.PU: 5},
        {S.PICKUP: a, S.DROPOFF: later(hours=4), S.PU: 5},
        {S.PICKUP: a, S.DROPOFF: later(hours=1), S.PU: 5},
    )
    got = sorted(r[0] for r in refund_rows(df).collect())
    rows = [r.asDict() for r in df.collect()]
    assert set(got) == brute_refunds(rows, (S.PICKUP, S.DROPOFF, S.PU))


def test_disputes_look_only_at_disputes(spark):
    a = later(minutes=0)
    df = make_trips(
        spark,
        {S.PAYMENT: 4, S.PICKUP: a},
        {S.PAYMENT: 1, S.PICKUP: later(minutes=5)},
        {S.PAYMENT: 4, S.PICKUP: a},
        {S.PAYMENT: 4, S.PICKUP: later(minutes=7)},
        {S.PAYMENT: 1, S.PICKUP: later(minutes=7)},
    )
    assert sorted(r[0] for r in dispute_rows(df).collect()) == [0, 2]
    assert sorted(r[0] for r in dispute_rows(df, levels=(1, 2)).collect()) == [0, 2]
