"""Hand-made cases for what the derived table does not contain."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.frames import later, make_trips, records
from triplens import schema as S
from triplens.functions.expressions import minutes, seconds
from triplens.functions.stats import (
    binned_percentiles,
    value_counts,
    weighted_median,
    weighted_percentile,
)
from triplens.operators import discrepancy as D
from triplens.operators import duplicates as U
from triplens.operators import durations as C
from triplens.operators import eda as E
from triplens.operators import outliers as O
from triplens.operators import profile as P
from triplens.operators import refunds as R
from triplens.operators import rules as Q
from triplens.operators import zones as Z


def one(df):
    (row,) = df.collect()
    return row.asDict()


# --- expressions


def test_seconds_keep_fractions_and_ignore_time_zones(spark):
    df = make_trips(
        spark,
        {S.DROPOFF: later(seconds=1, microseconds=500_000)},
        {S.PICKUP: dt.datetime(2025, 3, 9, 1, 59), S.DROPOFF: dt.datetime(2025, 3, 9, 3, 1)},
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [float(r[0]) for r in df.orderBy(S.ID).select(seconds()).collect()]
        mins = [r[0] for r in df.orderBy(S.ID).select(minutes()).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1.5, 3720.0]
    assert mins == [0.025, 62.0]


def test_counted_percentiles_equal_percentiles_of_rows(spark, trips):
    probs = [0.0, 0.05, 0.25, 0.5, 0.99, 0.9999, 1.0]
    counts = value_counts(trips, [S.VENDOR], {"x": F.col(S.TOTAL)})
    got = counts.groupBy(S.VENDOR).agg(weighted_percentile(F.col("value"), probs, F.col("n")).alias("q"))
    want = trips.groupBy(S.VENDOR).agg(
        F.percentile(F.col(S.TOTAL).cast("double"), F.array(*map(F.lit, probs))).alias("q")
    )
    assert records(got, S.VENDOR) == records(want, S.VENDOR)


@pytest.mark.parametrize("width", [0.01, 1.0, 7.5, 1e6])
def test_binned_percentiles_equal_percentiles_of_rows(spark, trips, width):
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 0.9999, 1.0]
    counts = value_counts(
        trips, [S.VENDOR], {"total": F.col(S.TOTAL), "secs": seconds(), "none": F.lit(None)}
    )
    got = binned_percentiles(counts, [S.VENDOR, "variable"], probs, width)
    want = counts.where(F.col("value").isNotNull()).groupBy(S.VENDOR, "variable").agg(
        weighted_percentile(F.col("value"), probs, F.col("n")).alias("q")
    )
    assert records(got, S.VENDOR, "variable") == records(want, S.VENDOR, "variable")
    everything = one(binned_percentiles(counts.where("variable = 'total'"), [], probs, width))
    rows = trips.agg(F.percentile(F.col(S.TOTAL).cast("double"), F.array(*map(F.lit, probs))).alias("q"))
    assert everything == one(rows)


def test_median_of_nothing_is_null(spark):
    df = make_trips(spark, {S.FARE: None})
    counts = value_counts(df, [], {"x": F.col(S.FARE)})
    assert one(counts.agg(weighted_median(F.col("value"), F.col("n")).alias("m"))) == {"m": None}


# --- profile


def test_partial_null_block(spark):
    df = make_trips(
        spark,
        {S.RATE: None, S.FLAG: None, S.CONGESTION: None, S.AIRPORT: None, S.PASSENGERS: None},
        {S.RATE: None, S.FLAG: None, S.CONGESTION: None},
        {S.RATE: None, S.FLAG: None},
        {S.PASSENGERS: None},
        {},
    )
    assert one(P.null_overlap(df)) == {
        "core": 2,
        "core_and_fee": 1,
        "core_fee_and_passengers": 1,
        "core_with_fee_present": 1,
        "passengers_beyond_core": 0,
    }


def test_freq_table_counts_null_unless_told(spark):
    df = make_trips(spark, {S.RATE: None}, {S.RATE: 1}, {S.RATE: 1})
    assert {(r[0], r[1]) for r in P.freq_table(df, S.RATE).collect()} == {(None, 1), (1, 2)}
    assert {(r[0], r[1]) for r in P.freq_table(df, S.RATE, dropna=True).collect()} == {(1, 2)}


# --- rules


def test_invalid_codes(spark):
    df = make_trips(
        spark,
        {S.RATE: 7, S.FLAG: "X", S.PAYMENT: 9},
        {S.RATE: None, S.FLAG: None, S.PAYMENT: None},
        {S.RATE: 99},
    )
    got = records(Q.code_violations(df), "variable")
    assert [got[c]["invalid"] for c in (S.RATE, S.FLAG, S.PAYMENT)] == [1, 1, 1]
    assert [got[c]["filled"] for c in (S.RATE, S.FLAG, S.PAYMENT)] == [2, 2, 2]
    rates = records(Q.code_breakdown(df, S.RATE, S.VALID_CODES[S.RATE]), S.RATE)
    assert rates[7]["is_valid"] is False and rates[99]["is_valid"] is True and None not in rates


def test_negative_distance_and_zero_duration(spark):
    df = make_trips(spark, {S.DISTANCE: -1.0}, {S.DISTANCE: 0.0}, {S.DROPOFF: later()})
    got = records(Q.distance_duration_counts(df), "rule")
    assert {k: v["n"] for k, v in got.items()} == {
        "negative_distance": 1,
        "zero_distance_with_duration": 1,
        "zero_duration_with_distance": 1,
    }


def test_one_cent_gap_is_exact(spark):
    """A gap of one cent is neither above one cent nor lost in binary noise."""
    df = make_trips(spark, {S.TOTAL: "16.76"}, {S.TOTAL: "16.77"}, {})
    assert one(Q.total_mismatch(df))["n"] == 1
    gaps = D.add_discrepancy(df)
    assert gaps.where(D.has_gap()).count() == 2


def test_three_ways_to_treat_null_components(spark):
    df = make_trips(spark, {S.CONGESTION: None, S.TOTAL: "99.00"}, {S.CBD: None, S.TOTAL: "99.00"})
    assert one(Q.total_mismatch(df))["n"] == 1
    by = one(Q.total_check_by(df))
    assert (by["trips"], by["mismatches"]) == (2, 1)
    assert D.add_discrepancy(df).where(D.has_gap()).count() == 2


def test_wrong_airport_fee(spark):
    df = make_trips(
        spark,
        {S.PU: 132, S.AIRPORT: "1.75"},
        {S.PU: 138, S.AIRPORT: "5.00"},
        {S.PU: 70, S.AIRPORT: "1.25"},
        {S.PU: None, S.AIRPORT: "2.00"},
        {S.PU: 70, S.AIRPORT: None},
    )
    got = {k: v["n"] for k, v in records(Q.airport_fee_anomalies(df), "rule").items()}
    assert got == {"wrong_zone": 2, "wrong_amount": 2, "either": 3}


def test_mix_compare_adds_up(spark, trips):
    rows = Q.mix_compare(trips).collect()
    assert sum(r["zero_duration"] for r in rows) == pytest.approx(100)
    assert sum(r["rest"] for r in rows) == pytest.approx(100)


def test_rates_of_an_empty_table_are_null_not_errors(spark):
    empty = make_trips(spark, {}).where("false")
    assert one(Q.total_mismatch(empty)) == {"rule": "total_mismatch", "n": 0, "pct": None}
    assert one(E.kpi_summary(empty))["total_trips"] == 0
    overall = one(D.discrepancy_overall(D.add_discrepancy(empty)))
    assert (overall["trips"], overall["exact"], overall["sd"]) == (0, 0, None)
    assert O.outlier_thresholds(empty).count() == 0
    assert E.histogram(empty, F.col(S.FARE)).count() == 0


# --- duplicates


def pair(**second):
    negative = {c: f"-{v}" for c, v in (("fare_amount", "10.00"), ("mta_tax", "0.50"), ("tip_amount", "2.00"),
                ("improvement_surcharge", "1.00"), ("congestion_surcharge", "2.50"),
                ("cbd_congestion_fee", "0.75"))}
    return {**negative, **second}


@pytest.mark.parametrize(
    ("rows", "category"),
    [
        ([{}, {}], U.SAME_SIGN),
        ([{}, pair()], U.MIRROR),
        ([{}, pair(tip_amount="0.00")], U.EXCEPT_TIP),
        ([{}, pair(congestion_surcharge="0.00")], U.EXCEPT_SURCHARGE),
        ([{}, pair(tip_amount="0.00", cbd_congestion_fee="0.00")], U.EXCEPT_BOTH),
        ([{}, pair(mta_tax="0.00")], U.CORE_DIFFERS),
        ([{}, pair(extra=None)], U.OTHER),
        ([{}, pair(tip_amount=None)], U.OTHER),
        ([{}, pair(congestion_surcharge=None, tip_amount="-2.00")], U.EXCEPT_SURCHARGE),
        ([{}, {"fare_amount": "0.00"}], U.OTHER),
        ([{}, pair(), pair()], U.MORE_THAN_TWO),
    ],
)
def test_pair_categories(spark, rows, category):
    got = one(U.pair_classify(make_trips(spark, *rows)).select("category", "n"))
    assert got == {"category": category, "n": len(rows)}


def test_null_keys_are_equal_and_ids_name_groups(spark):
    df = make_trips(spark, {S.RATE: None}, {S.RATE: None}, {S.RATE: 1}, {S.PU: None}, {S.PU: None})
    got = U.dup_rows(df, S.STRICT_KEYS).select(S.ID, U.GROUP).collect()
    assert {tuple(r) for r in got} == {(0, 0), (1, 0), (3, 3), (4, 3)}
    assert one(U.dup_counts(df, S.STRICT_KEYS)) == {"n_rows": 4, "n_groups": 2}


def test_exact_copies_differ_only_in_id(spark):
    df = make_trips(spark, {}, {}, {S.TIP: "9.00"}, {S.FLAG: None}, {S.FLAG: None})
    assert {r[0] for r in U.exact_dups(df).select(S.ID).collect()} == {0, 1, 3, 4}
    assert one(U.exact_dup_counts(df, exclude=())) == {"n_rows": 0, "n_groups": 0}


def test_examples_keep_whole_groups(spark):
    df = make_trips(spark, *[{S.DISTANCE: float(i % 4)} for i in range(40)])
    got = U.pair_examples(df, n=2).collect()
    assert {r["category"] for r in got} == {U.MORE_THAN_TWO} and len(got) == 20


# --- discrepancy


def test_null_gap_falls_into_the_last_band(spark):
    df = D.add_discrepancy_bands(D.add_discrepancy(make_trips(spark, {S.FARE: None})))
    row = one(df.select("has_discrepancy", "discrepancy_band", "discrepancy_sign"))
    assert row == {
        "has_discrepancy": None,
        "discrepancy_band": D.LARGEST_BAND,
        "discrepancy_sign": D.SIGN_LESS,
    }


@pytest.mark.parametrize(
    ("gap", "band"), [(0, 0), (0.01, 1), (0.5, 2), (1, 3), (4.99, 3), (5, 4), (10, 5), (50, 6), (-50, 6)]
)
def test_band_edges(spark, gap, band):
    df = make_trips(spark, {S.TOTAL: f"{16.75 + gap:.2f}"})
    names = [n for _, n in D.BANDS] + [D.LARGEST_BAND]
    assert one(D.add_discrepancy(df).select(D.gap_band().alias("b")))["b"] == names[band]


def test_top_gaps_keep_ties(spark):
    df = make_trips(spark, *[{S.TOTAL: t} for t in ("20.00", "30.00", "30.00", "30.00", "18.00")])
    got = D.top_gaps(D.add_discrepancy(df), n=2)
    assert sorted(r[S.ID] for r in got.collect()) == [1, 2, 3]


def test_modal_values_cut_ties_by_smaller_gap(spark):
    totals = ["18.75", "18.75", "19.75", "19.75", "20.75"]
    gaps = D.add_discrepancy(make_trips(spark, *[{S.TOTAL: t} for t in totals]))
    assert [float(r[D.GAP]) for r in D.modal_values(gaps, k=1).collect()] == [2.0]
    got = D.modal_values_by_vendor(gaps, k=2).collect()
    assert sorted(float(r[D.GAP]) for r in got) == [2.0, 3.0]


def test_implied_rate_order(spark):
    df = make_trips(spark, {S.PU: 1, S.DO: 1}, {S.PU: 138}, {S.DO: 265}, {S.PU: None, S.DO: None})
    assert [r[0] for r in df.orderBy(S.ID).select(D.implied_rate()).collect()] == [2, 2, 4, 1]


def test_filled_fees_enter_the_gap(spark):
    row = one(D.add_discrepancy(make_trips(spark, {S.CONGESTION: None})).select(D.GAP, S.CONGESTION))
    assert [float(v) for v in row.values()] == [0.0, 0.0]


# --- negative rows, durations


def test_any_negative_is_null_only_if_undecided(spark):
    df = make_trips(spark, {S.TIP: None}, {S.TIP: None, S.FARE: "-1.00"}, {})
    assert [r[0] for r in df.orderBy(S.ID).select(R.any_negative()).collect()] == [None, True, False]


def test_most_negative_durations_keep_ties(spark):
    ends = [later(minutes=-5), later(minutes=-5), later(minutes=-3), later(minutes=-9)]
    df = make_trips(spark, *[{S.DROPOFF: e} for e in ends])
    assert sorted(r[S.ID] for r in C.neg_duration_examples(df, n=2).collect()) == [0, 1, 3]


def test_vendors_without_negative_durations_show_null(spark):
    df = make_trips(spark, {S.VENDOR: 1}, {S.VENDOR: 2, S.DROPOFF: later(minutes=-1)})
    got = records(C.neg_duration_by_vendor(df), "vendor")
    assert got["CMT"]["most_negative"] is None and got["CMT"]["mean_fare"] is None
    assert got["Curb Mobility"]["most_negative"] == -1.0


def test_unknown_vendor_names_differ_by_study(spark):
    df = make_trips(spark, {S.VENDOR: None}, {S.VENDOR: 9})
    assert {r["vendor"] for r in C.ts_by_vendor(df).collect()} == {"Unknown"}
    assert {r["vendor"] for r in D.by_vendor(D.add_discrepancy(df)).collect()} == {"Other"}


# --- aggregates


def test_shares_treat_null_as_each_figure_says(spark):
    df = make_trips(spark, {S.PAYMENT: None, S.PU: None}, {S.PAYMENT: 1, S.PU: 132})
    row = one(E.kpi_summary(df))
    assert row["credit_card_share"] == 1.0 and row["airport_pickup_share"] == 0.5


def test_bands_are_closed_on_the_right(spark):
    df = make_trips(
        spark,
        {S.DISTANCE: 0.0, S.DROPOFF: later()},
        {S.DISTANCE: 1.0, S.DROPOFF: later(minutes=5)},
        {S.DISTANCE: 1.01, S.DROPOFF: later(minutes=5, microseconds=1)},
        {S.DISTANCE: 20.5, S.DROPOFF: later(hours=2)},
    )
    got = {(r["distance_band"], r["duration_band"]): r["trips"] for r in E.band_matrix(df).collect()}
    assert got == {("[0,1]", "[0,5]"): 2, ("(1,3]", "(5,10]"): 1, ("(20,Inf]", "(60,Inf]"): 1}


def test_histogram_counts_everything_up_to_the_cap(spark, trips):
    got = E.histogram(trips, F.col(S.FARE), bins=10).collect()
    values = sorted(float(r[0]) for r in trips.select(S.FARE).where(F.col(S.FARE) >= 0).collect())
    cap = trips.where(F.col(S.FARE) >= 0).agg(F.percentile(F.col(S.FARE), 0.99)).first()[0]
    assert sum(r["n"] for r in got) == sum(v <= cap for v in values)
    assert [r["bin"] for r in got] == list(range(10))


def test_sample_is_exact_in_size_and_repeatable(spark, trips):
    a = {r[S.ID] for r in E.sample_points(trips, n=100).collect()}
    b = {r[S.ID] for r in E.sample_points(trips.repartition(3), n=100).collect()}
    other = {r[S.ID] for r in E.sample_points(trips, n=100, seed=1).collect()}
    assert len(a) == 100 and a == b and a != other
    everything = E.sample_points(trips, n=10**9).count()
    assert everything == trips.where((F.col(S.DISTANCE) >= 0) & (F.col(S.TOTAL) >= 0)).count()


def test_zones_without_trips_have_no_data(spark):
    zones = spark.createDataFrame([(100, "a"), (7, "b")], "LocationID int, Zone string")
    df = make_trips(spark, {S.TOTAL: "60000.00"}, {S.PU: 265}, {S.TOTAL: "-5.00"})
    got = records(Z.zone_revenue_groups(zones, Z.zone_revenue(df)), "LocationID")
    assert got[100]["revenue_group"] == "50k–100k" and got[100]["trips"] == 1
    assert got[7]["revenue_group"] == Z.NO_DATA


def test_zone_kpis_weigh_fares_by_trips(spark):
    agg = spark.createDataFrame(
        [(1, 3, 30.0, 10.0, 1.0, "pickup"), (2, 1, 50.0, 50.0, 1.0, "pickup"), (2, 9, 1.0, 1.0, 1.0, "dropoff")],
        "LocationID int, trips long, revenue double, avg_fare double, avg_tip double, zone_type string",
    )
    assert one(Z.zone_kpis(agg)) == {"trips": 4, "revenue": 80.0, "avg_fare": 20.0}
