from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.frames import NOON, later, make_trips, records
from triplens import schema as S
from triplens.plans import cleaning as K


def apart(*changes):
    """Rows whose pickup times differ, so that none looks like a refund."""
    return [
        {S.PICKUP: later(hours=i), S.DROPOFF: later(hours=i, minutes=10), **c}
        for i, c in enumerate(changes)
    ]


def steps(spark, *changes):
    marked = K.with_failed_step(make_trips(spark, *apart(*changes)))
    return [r[0] for r in marked.orderBy(S.ID).select(K.STEP).collect()]


def test_first_failed_step(spark):
    assert steps(
        spark,
        {},
        {S.PICKUP: NOON.replace(year=2024), S.DROPOFF: NOON.replace(year=2024)},
        {S.DROPOFF: NOON.replace(year=2024)},
        {S.DISTANCE: 0.0},
        {S.DISTANCE: 100.0},
        {S.DROPOFF: later(hours=30)},
        {S.PU: 264},
        {S.FARE: "2.99"},
        {S.FARE: "3.50"},
        {S.FARE: "300.00"},
        {S.FARE: "4.00", S.TOTAL: "4.50"},
    ) == [None, 3, 4, 6, 6, 7, 8, 9, 9, 10, 12]


def test_null_outcomes_drop_or_keep_by_step(spark):
    assert steps(
        spark,
        {S.PICKUP: None},
        {S.DROPOFF: None},
        {S.DISTANCE: None},
        {S.PU: None},
        {S.FARE: None, S.TOTAL: "20.00"},
        {S.TOTAL: None},
        {S.RATE: None, S.FARE: "3.50"},
        {S.RATE: None, S.FARE: "5.00"},
    ) == [3, 4, 6, None, 10, 10, 10, None]


def test_window_end_and_fractions(spark):
    last = NOON.replace(month=3, day=31, hour=23, minute=59, second=59)
    assert steps(
        spark,
        {S.PICKUP: last, S.DROPOFF: last},
        {S.PICKUP: last.replace(microsecond=1), S.DROPOFF: last},
    ) == [None, 3]


def test_clean_and_report_agree(spark, trips):
    clean = K.clean_trips(trips)
    marked = K.with_failed_step(trips)
    kept = marked.where(F.col(K.STEP).isNull()).select(S.ID)
    assert clean.count() == kept.count() == kept.join(clean, S.ID, "left_semi").count()
    report = K.cleaning_report(marked).orderBy("step").collect()
    assert [r["step"] for r in report] == list(range(1, 15))
    assert report[0]["before"] == trips.count() and report[-1]["remaining"] == clean.count()
    for a, b in zip(report, report[1:], strict=False):
        assert a["before"] - a["dropped"] == a["remaining"] == b["before"]


@pytest.mark.parametrize("levels", [(20, 22), (6, 5), (9,)])
def test_blocks_do_not_change_the_result(spark, trips, levels):
    want = {r[0] for r in K.clean_trips(trips).select(S.ID).collect()}
    assert {r[0] for r in K.clean_trips(trips, levels=levels).select(S.ID).collect()} == want


def test_totals_equal_parts_after_repair(spark, trips):
    clean = K.clean_trips(trips)
    assert clean.where(F.col(S.TOTAL) != sum(F.col(p) for p in S.PARTS)).count() == 0
    assert clean.where(" OR ".join(f"{p} IS NULL" for p in S.PARTS)).count() == 0
    assert dict(clean.dtypes)[S.TOTAL] == "decimal(12,2)"


def test_repair(spark):
    df = make_trips(
        spark,
        {S.EXTRA: "-1.00"},
        {S.EXTRA: "-1.00", S.FARE: "-5.00"},
        {S.PU: 132, S.AIRPORT: None},
        {S.PU: 5, S.AIRPORT: "1.75", S.CONGESTION: None},
    )
    got = records(K.repair(df), S.ID)
    assert [float(got[i][S.EXTRA]) for i in range(2)] == [0.0, -1.0]
    assert [float(got[i][S.AIRPORT]) for i in (2, 3)] == [1.75, 0.0]
    assert float(got[3][S.TOTAL]) == 10 + 0.5 + 2 + 1 + 0.75


def test_refunds_and_adjacent_disputes_go_first(spark):
    df = make_trips(
        spark,
        {},
        {S.FARE: "-10.00"},
        {S.PICKUP: later(hours=5), S.DROPOFF: later(hours=6), S.PAYMENT: 4},
        {S.PICKUP: later(hours=5), S.DROPOFF: later(hours=7), S.PAYMENT: 4},
        {S.PICKUP: later(hours=9), S.DROPOFF: later(hours=9, minutes=5)},
    )
    got = records(K.with_failed_step(df), S.ID)
    assert [got[i][K.STEP] for i in range(5)] == [1, 1, 2, 2, None]


def test_vendor_without_clean_rows_keeps_its_line(spark):
    raw = make_trips(spark, {S.VENDOR: 1}, {S.VENDOR: None})
    got = records(K.revenue_by_vendor(raw, raw.where("VendorID = 1")), S.VENDOR)
    assert got[1] == {S.VENDOR: 1, "revenue_before": 16.75, "revenue_after": 16.75}
    assert got[None]["revenue_after"] is None


def test_without_a_shared_folder_the_result_is_the_same(spark, trips, monkeypatch):
    from triplens.functions import stats
    from triplens.operators import neighbours
    from triplens.sources import shared

    want = {r[0] for r in neighbours.refund_rows(trips).collect()}
    for module in (shared, neighbours, stats):
        monkeypatch.setattr(module, "shared_folder", lambda spark: None)
    assert {r[0] for r in neighbours.refund_rows(trips).collect()} == want
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.new_path(spark, "x")
