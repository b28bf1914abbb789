"""Oracles for the discrepancy, negative-rows and timestamp studies."""

from __future__ import annotations

from oracles.base import (
    AFTER,
    FLAGGED,
    GAPS,
    MONEY,
    PARTS,
    POLICY,
    START,
    case,
    cnt,
    mean,
    med,
    pct,
    query,
    stack,
    whole_pct,
)

ORACLES: dict[str, str] = {}

PAYMENT = {
    1: "1-Credit card", 2: "2-Cash", 3: "3-No charge", 4: "4-Dispute", 5: "5-Unknown", 6: "6-Voided",
}
VENDOR = {1: "1-CMT", 2: "2-Curb Mobility", 6: "6-Myle Technologies", 7: "7-Helix"}
SHORT_VENDOR = VENDOR | {6: "6-Myle"}
RATE = {
    1: "1 - Standard Metered", 2: "2 - JFK Flat Rate", 3: "3 - Newark",
    4: "4 - Nassau/Westchester", 5: "5 - Negotiated", 6: "6 - Group Ride",
}
CLOCK_VENDOR = {1: "CMT", 2: "Curb Mobility", 6: "Myle Technologies", 7: "Helix"}
CLOCK_PAYMENT = {
    1: "1 - Credit Card", 2: "2 - Cash", 3: "3 - No Charge", 4: "4 - Dispute", 5: "5 - Unknown",
    6: "6 - Voided Trip",
}
BAND = (
    "CASE WHEN abs(gap) < 0.01 THEN 'Exact / rounding (<$0.01)' WHEN abs(gap) < 0.5 THEN 'Tiny ($0.01–$0.49)'"
    " WHEN abs(gap) < 1 THEN 'Small ($0.50–$0.99)' WHEN abs(gap) < 5 THEN 'Medium ($1–$4.99)'"
    " WHEN abs(gap) < 10 THEN 'Large ($5–$9.99)' WHEN abs(gap) < 50 THEN 'Very large ($10–$49.99)'"
    " ELSE 'Extreme (>=$50)' END"
)
POSITION = (
    "CASE WHEN abs(gap) < 0.01 THEN 0 WHEN abs(gap) < 0.5 THEN 1 WHEN abs(gap) < 1 THEN 2"
    " WHEN abs(gap) < 5 THEN 3 WHEN abs(gap) < 10 THEN 4 WHEN abs(gap) < 50 THEN 5 ELSE 6 END"
)
SIGN = (
    "CASE WHEN abs(gap) < 0.01 THEN 'Exact' WHEN gap > 0 THEN 'Positive (total > sum)'"
    " ELSE 'Negative (total < sum)' END"
)

ORACLES["add_discrepancy"] = query(
    "SELECT trip_id, gap::DOUBLE AS discrepancy, expected_gap::DOUBLE AS expected_discrepancy, implied_rate,"
    " mins AS duration_mins, CASE WHEN secs = 0 THEN 'zero_duration' WHEN secs < 0 AND VendorID IN (6, 7)"
    " THEN 'negative_duration_v6_v7' END AS duration_issue, total_amount < 0 OR fare_amount < 0 AS has_negative_amount"
    " FROM g",
    *GAPS,
)
ORACLES["add_discrepancy_bands"] = query(
    f"SELECT trip_id, abs(gap)::DOUBLE AS abs_discrepancy, has AS has_discrepancy, {BAND} AS discrepancy_band,"
    f" {SIGN} AS discrepancy_sign FROM g",
    *GAPS,
)
ORACLES["discrepancy_overall"] = query(
    f"SELECT count(*) AS trips, {cnt('has')} AS discrepant, count(*) - {cnt('has')} AS exact,"
    f" {pct(cnt('has'), 'count(*)')} AS pct_discrepant,"
    + ", ".join(
        f"round({e}, 9) AS {n}"
        for n, e in {
            "mean": mean("gap", "has"),
            "sd": "stddev_samp(gap::DOUBLE) FILTER (WHERE has)",
            "p5": med("gap", "has", 0.05),
            "p25": med("gap", "has", 0.25),
            "median": med("gap", "has"),
            "p75": med("gap", "has", 0.75),
            "p95": med("gap", "has", 0.95),
            "p99": med("gap", "has", 0.99),
            "min": "(min(gap) FILTER (WHERE has))::DOUBLE",
            "max": "(max(gap) FILTER (WHERE has))::DOUBLE",
        }.items()
    )
    + " FROM g",
    *GAPS,
).replace(f"{pct(cnt('has'), 'count(*)')} AS", f"round({pct(cnt('has'), 'count(*)')}, 9) AS")
ORACLES["discrepancy_buckets"] = query(
    f"SELECT position, band, n, {whole_pct('n')} AS pct_of_rows,"
    " 100.0::DOUBLE * n / (sum(CASE WHEN position > 0 THEN n ELSE 0 END) OVER ())::DOUBLE AS pct_of_discrepant"
    f" FROM (SELECT {POSITION} AS position, {BAND} AS band, count(*) AS n FROM g GROUP BY ALL)",
    *GAPS,
)
ORACLES["discrepancy_signs"] = query(
    f"SELECT sign, n, {whole_pct('n')} AS pct FROM (SELECT {SIGN} AS sign, count(*) AS n FROM g GROUP BY ALL)",
    *GAPS,
)


def _summary(keys: str, where: str = "TRUE", with_mean: bool = True) -> str:
    names = ", ".join(k.split(" AS ")[-1] for k in keys.split(" ; "))
    last = f", {mean('gap', 'has')} AS mean_gap" if with_mean else ""
    return (
        f"SELECT {keys.replace(' ; ', ', ')}, count(*) AS trips, {cnt('has')} AS discrepant,"
        f" {pct(cnt('has'), 'count(*)')} AS pct_discrepant, {med('gap', 'has')} AS median_gap{last}"
        f" FROM g WHERE {where} GROUP BY {names}"
    )


GOOD = "(VendorID IS NULL OR VendorID NOT IN (6, 7))"
CONGESTION_ZONES = (
    "(4, 12, 13, 24, 41, 42, 43, 45, 48, 50, 68, 74, 75, 79, 87, 88, 90, 100, 103, 104, 105, 107, 113, 114, 116,"
    " 120, 125, 127, 128, 137, 140, 141, 142, 143, 144, 148, 151, 152, 153, 158, 161, 162, 163, 164, 166, 170,"
    " 186, 194, 202, 209, 211, 224, 229, 230, 231, 232, 233, 234, 236, 237, 238, 239, 243, 244, 246, 249, 261,"
    " 262, 263)"
)
GAP_ZONES = "(232, 224, 4, 54, 45, 209, 66, 87, 33, 40, 128, 50, 88, 158, 148, 79, 255, 144, 256, 112)"
ZONE_GROUP = f"CASE WHEN PULocationID IN {CONGESTION_ZONES} THEN 'Congestion Zone' ELSE 'Outside Zone' END"
DAYPART = (
    "CASE WHEN hour(tpep_pickup_datetime) BETWEEN 6 AND 11 THEN 'Morning (6–11)'"
    " WHEN hour(tpep_pickup_datetime) BETWEEN 12 AND 16 THEN 'Afternoon (12–16)'"
    " WHEN hour(tpep_pickup_datetime) BETWEEN 17 AND 19 THEN 'Rush Hour (17–19)' ELSE 'Night (20–5)' END"
)
for name, keys, where in (
    ("discrepancy_by_payment", case("payment_type", PAYMENT, "Other") + " AS payment", "TRUE"),
    ("discrepancy_by_vendor", case("VendorID", VENDOR, "Other") + " AS vendor", "TRUE"),
    ("discrepancy_by_month", "strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_month", "TRUE"),
    ("discrepancy_by_hour", "hour(tpep_pickup_datetime)::INT AS pickup_hour", GOOD),
    ("discrepancy_by_rate", case("RatecodeID", RATE, "Other") + " AS rate", "TRUE"),
    ("discrepancy_by_zone_group", f"{ZONE_GROUP} AS zone", GOOD),
    ("discrepancy_by_daypart_zone", f"{ZONE_GROUP} AS zone ; {DAYPART} AS part_of_day", GOOD),
    ("rate_changed_summary", "changed AS rate_changed", "TRUE"),
):
    ORACLES[name] = query(_summary(keys, where), *GAPS)
ORACLES["cash_tip_recon"] = query(
    f"SELECT count(*) AS cash_rows, {cnt('gap < 50')} AS plausible_tip, {med('gap', 'gap < 50')} AS median_plausible_tip"
    " FROM g WHERE payment_type = 2 AND gap > 0.01",
    *GAPS,
)
ORACLES["component_diagnosis"] = query(
    stack(
        [
            f"'{p}' AS component, {cnt(f'{p} = 0')} AS n_zero, {pct(cnt(f'{p} = 0'), 'count(*)')} AS pct_zero,"
            f" {cnt(f'{p} IS NULL')} AS n_null, {pct(cnt(f'{p} IS NULL'), 'count(*)')} AS pct_null,"
            f" {cnt(f'{p} < 0')} AS n_negative"
            for p in PARTS
        ],
        "(SELECT * FROM g WHERE has)",
    ),
    *GAPS,
)
MEDIUM = "m AS (SELECT * FROM g WHERE abs(gap) >= 1 AND abs(gap) < 5)"
ORACLES["modal_values"] = query(
    f"SELECT gap::DOUBLE AS discrepancy, n, {whole_pct('n')} AS pct_of_band"
    " FROM (SELECT gap, count(*) AS n FROM m GROUP BY gap) ORDER BY n DESC, gap LIMIT 20",
    *GAPS,
    MEDIUM,
)
ERA = f"CASE WHEN tpep_pickup_datetime >= {POLICY} THEN 'post_cbd' ELSE 'pre_cbd' END"
for name, key, alias, k in (
    ("modal_values_by_vendor", case("VendorID", SHORT_VENDOR, "Other"), "vendor", 5),
    ("modal_values_by_era", ERA, "era", 10),
):
    ORACLES[name] = query(
        f"SELECT * FROM (SELECT {alias}, gap::DOUBLE AS discrepancy, n,"
        f" row_number() OVER (PARTITION BY {alias} ORDER BY n DESC, gap)::INT AS place"
        f" FROM (SELECT {key} AS {alias}, gap, count(*) AS n FROM m GROUP BY ALL)) WHERE place <= {k}",
        *GAPS,
        MEDIUM,
    )
ORACLES["medium_band_eras"] = query(
    f"SELECT count(*) AS rows_in_band, {cnt(f'tpep_pickup_datetime < {POLICY}')} AS pre_cbd,"
    f" {cnt(f'tpep_pickup_datetime >= {POLICY}')} AS post_cbd FROM m",
    *GAPS,
    MEDIUM,
)
ORACLES["top_gaps"] = query(
    "SELECT trip_id, tpep_pickup_datetime, VendorID, payment_type, fare_amount::DOUBLE AS fare_amount,"
    " tip_amount::DOUBLE AS tip_amount, total_amount::DOUBLE AS total_amount, gap::DOUBLE AS discrepancy,"
    " expected_gap::DOUBLE AS expected_discrepancy"
    " FROM (SELECT *, rank() OVER (ORDER BY abs(gap) DESC) AS place FROM g WHERE has) WHERE place <= 20",
    *GAPS,
)
ORACLES["rate_changed_crosstab"] = query(
    f"SELECT rate_changed, has_discrepancy, n, {whole_pct('n', 'rate_changed')} AS pct_within FROM"
    " (SELECT changed AS rate_changed, has AS has_discrepancy, count(*) AS n FROM g GROUP BY ALL)",
    *GAPS,
)
ORACLES["rate_changed_pairs"] = query(
    f"SELECT RatecodeID, implied_rate, count(*) AS trips, {cnt('has')} AS discrepant,"
    f" {pct(cnt('has'), 'count(*)')} AS pct_discrepant FROM g WHERE changed GROUP BY RatecodeID, implied_rate",
    *GAPS,
)
for name, zone, order in (
    ("discrepancy_zone_top_pickup", "PULocationID", "discrepant"),
    ("discrepancy_zone_top_dropoff", "DOLocationID", "discrepant"),
    ("discrepancy_zone_top_rate", "PULocationID", "pct_discrepant"),
):
    for least, suffix in ((20, ""), (100, "_100")):
        ORACLES[name + suffix] = query(
            f"{_summary(zone, GOOD, False)} HAVING count(*) >= {least} ORDER BY {order} DESC, {zone} LIMIT 20", *GAPS
        )
MATCH = "abs(gap - congestion_surcharge) < 0.01"
ORACLES["congestion_match"] = query(
    f"SELECT count(*) AS discrepant, {cnt(MATCH)} AS matching, {pct(cnt(MATCH), 'count(*)')} AS pct_matching"
    f" FROM g WHERE PULocationID IN {GAP_ZONES} AND has",
    *GAPS,
)
ORACLES["congestion_inverse"] = query(
    f"SELECT has AS has_discrepancy, count(*) AS trips, {pct(cnt('congestion_surcharge = 0'), 'count(*)')}"
    f" AS pct_zero_surcharge, {med('congestion_surcharge')} AS median_surcharge,"
    f" {mean('congestion_surcharge')} AS mean_surcharge FROM g WHERE PULocationID IN {GAP_ZONES} GROUP BY has",
    *GAPS,
)
ORACLES["congestion_vendor"] = query(
    f"SELECT vendor, n, {whole_pct('n')} AS pct FROM (SELECT {case('VendorID', SHORT_VENDOR, 'Other')} AS vendor,"
    f" count(*) AS n FROM g WHERE PULocationID IN {GAP_ZONES} AND has GROUP BY ALL)",
    *GAPS,
)

# --- negative rows
ORACLES["any_negative"] = query(
    f"SELECT count(*) AS trips, {cnt('any_negative')} AS any_negative FROM f", *FLAGGED
)
ORACLES["negative_vs_refund"] = query(
    f"SELECT {cnt('is_refund_pair')} AS refund_rows, {cnt('any_negative AND is_refund_pair')} AS negative_in_refund,"
    f" {cnt('any_negative AND NOT is_refund_pair')} AS negative_outside FROM f",
    *FLAGGED,
)


def _split(key: str, alias: str, where: str) -> str:
    return query(
        f"SELECT {alias}, n, {whole_pct('n')} AS pct FROM"
        f" (SELECT {key} AS {alias}, count(*) AS n FROM f WHERE {where} GROUP BY ALL)",
        *FLAGGED,
    )


SIDE = (
    "CASE WHEN total_amount < 0 THEN 'Negative (void)' WHEN total_amount >= 0 THEN 'Positive (charge)'"
    " ELSE 'NA/zero' END"
)
ORPHAN = "any_negative AND NOT is_refund_pair"
ORACLES["refund_sides"] = _split(SIDE, "side", "is_refund_pair")
ORACLES["negative_by_payment"] = _split(case("payment_type", PAYMENT, "Other"), "payment", "any_negative")
ORACLES["negative_by_vendor"] = _split(case("VendorID", VENDOR, "Other"), "vendor", "any_negative")
ORACLES["orphan_by_payment"] = _split(case("payment_type", PAYMENT, "Other"), "payment", ORPHAN)
ORACLES["orphan_negatives"] = query(
    f"SELECT count(*) AS orphans, {med('total_amount')} AS median_total, {mean('total_amount')} AS mean_total,"
    f" {med('fare_amount')} AS median_fare, {mean('fare_amount')} AS mean_fare FROM f WHERE {ORPHAN}",
    *FLAGGED,
)
ORACLES["negative_by_column_split"] = query(
    "SELECT * FROM ("
    + stack(
        [
            f"'{c}' AS variable, {cnt(f'{c} < 0')} AS negative, {cnt(f'{c} < 0 AND is_refund_pair')} AS in_refund,"
            f" {cnt(f'{c} < 0 AND NOT is_refund_pair')} AS orphan,"
            f" {pct(cnt(f'{c} < 0 AND is_refund_pair'), cnt(f'{c} < 0'))} AS pct_in_refund"
            for c in MONEY
        ],
        "f",
    )
    + ") WHERE negative > 0",
    *FLAGGED,
)
ORACLES["negative_monthly"] = query(
    "SELECT strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_month, count(*) AS n FROM f WHERE any_negative"
    " GROUP BY pickup_month",
    *FLAGGED,
)

# --- timestamps and durations
TESTS = {
    "pickup_before_window": f"tpep_pickup_datetime < {START}",
    "pickup_after_window": f"tpep_pickup_datetime >= {AFTER}",
    "dropoff_before_window": f"tpep_dropoff_datetime < {START}",
    "dropoff_after_window": f"tpep_dropoff_datetime >= {AFTER}",
}
TS = (
    f"x AS (SELECT *, {case('VendorID', CLOCK_VENDOR, 'Unknown')} AS vendor, "
    + ", ".join(f"{c} AS {n}" for n, c in TESTS.items())
    + ", "
    + " OR ".join(TESTS.values())
    + " AS any_ts_issue FROM t)"
)
NAMES = (*TESTS, "any_ts_issue")
ORACLES["ts_flags"] = query(
    f"SELECT trip_id, vendor, mins AS duration_mins, {', '.join(NAMES)} FROM x", TS
)
ORACLES["ts_headline"] = query(
    stack([f"'{n}' AS issue, {cnt(n)} AS n, {pct(cnt(n), 'count(*)')} AS pct" for n in NAMES], "x"), TS
)
ORACLES["ts_by_vendor"] = query(
    f"SELECT vendor, count(*) AS trips, {', '.join(f'{cnt(n)} AS {n}' for n in NAMES)},"
    f" {pct(cnt('any_ts_issue'), 'count(*)')} AS pct_any_ts_issue FROM x GROUP BY vendor",
    TS,
)
ORACLES["ts_range_by_vendor"] = query(
    "SELECT vendor, min(tpep_pickup_datetime) AS earliest_pickup, max(tpep_pickup_datetime) AS latest_pickup,"
    " min(tpep_dropoff_datetime) AS earliest_dropoff, max(tpep_dropoff_datetime) AS latest_dropoff"
    " FROM x GROUP BY vendor",
    TS,
)
NEGATIVE = (
    f"{cnt('secs < 0')} AS negative, {pct(cnt('secs < 0'), 'count(*)')} AS pct,"
    f" min(mins) FILTER (WHERE secs < 0) AS most_negative, {med('mins', 'secs < 0')} AS median_mins"
)
ORACLES["neg_duration_headline"] = query(f"SELECT {NEGATIVE} FROM t")
ORACLES["neg_duration_by_vendor"] = query(
    f"SELECT vendor, count(*) AS trips, {NEGATIVE}, {mean('fare_amount', 'secs < 0')} AS mean_fare"
    " FROM x GROUP BY vendor",
    TS,
)
ORACLES["neg_duration_examples"] = query(
    "SELECT trip_id, vendor, tpep_pickup_datetime, tpep_dropoff_datetime, mins AS duration_mins,"
    " fare_amount::DOUBLE AS fare_amount, total_amount::DOUBLE AS total_amount, payment_type"
    " FROM (SELECT *, rank() OVER (ORDER BY mins) AS place FROM x WHERE mins < 0) WHERE place <= 5",
    TS,
)
ZERO_FARE, ZERO_DISTANCE = "secs = 0 AND fare_amount <> 0", "secs = 0 AND trip_distance <> 0"
ORACLES["zero_duration_headline"] = query(
    f"SELECT {cnt('secs = 0')} AS zero, {pct(cnt('secs = 0'), 'count(*)')} AS pct, {cnt(ZERO_FARE)} AS with_fare,"
    f" {pct(cnt(ZERO_FARE), cnt('secs = 0 AND fare_amount IS NOT NULL'))} AS pct_with_fare,"
    f" {cnt(ZERO_DISTANCE)} AS with_distance,"
    f" {pct(cnt(ZERO_DISTANCE), cnt('secs = 0 AND trip_distance IS NOT NULL'))} AS pct_with_distance,"
    f" {mean('fare_amount', ZERO_FARE)} AS mean_fare, {mean('trip_distance', ZERO_DISTANCE)} AS mean_distance FROM t"
)
ORACLES["zero_duration_by_vendor"] = query(
    f"SELECT vendor, count(*) AS trips, {cnt('secs = 0')} AS zero, {pct(cnt('secs = 0'), 'count(*)')} AS pct,"
    f" {cnt(ZERO_FARE)} AS with_fare, {cnt(ZERO_DISTANCE)} AS with_distance,"
    f" {mean('fare_amount', 'secs = 0')} AS mean_fare FROM x GROUP BY vendor",
    TS,
)
ORACLES["zero_vs_rest_payment"] = query(
    f"SELECT trip_group, payment, n, {whole_pct('n', 'trip_group')} AS pct_within FROM"
    " (SELECT CASE WHEN secs = 0 THEN 'Zero Duration' ELSE 'Normal Trip' END AS trip_group,"
    f" {case('payment_type', CLOCK_PAYMENT, 'Other')} AS payment, count(*) AS n FROM t GROUP BY ALL)"
)
ISSUES = {
    "out_of_range": "any_ts_issue",
    "negative_duration": "mins < 0",
    "zero_duration": "mins = 0",
    "any_issue": "any_ts_issue OR mins <= 0",
}
ORACLES["issues_by_vendor"] = query(
    f"SELECT vendor, count(*) AS trips, {', '.join(f'{cnt(c)} AS {n}' for n, c in ISSUES.items())}, "
    + ", ".join(f"{pct(cnt(c), 'count(*)')} AS pct_{n}" for n, c in ISSUES.items())
    + " FROM x GROUP BY vendor",
    TS,
)
