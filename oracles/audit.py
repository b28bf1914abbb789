"""Oracles for sources, profile, duplicates, rules and outliers."""

from __future__ import annotations

from oracles.base import (
    AFTER,
    CLEAN_STEPS,
    COLUMNS,
    FLAGGED,
    MONEY,
    PARTS,
    POLICY,
    RAW_DISPUTES,
    REFUNDS,
    START,
    ZONES,
    cnt,
    columns,
    mean,
    med,
    pct,
    query,
    rules,
    stack,
    whole_pct,
)

ORACLES: dict[str, str] = {}

# --- sources and sinks
ORACLES["read_trips"] = query(f"SELECT {columns()} FROM t")
ORACLES["read_zone_lookup"] = query("SELECT * FROM zones", *ZONES)
ORACLES["read_zone_shapes"] = query(
    "SELECT LocationID, 'MULTIPOLYGON (((' || LocationID || ' 0, ' || LocationID || ' 1,' || chr(10) ||"
    " LocationID || ' 1, ' || LocationID || ' 0)))' AS shape FROM zones",
    *ZONES,
)
CLEAN_COLUMNS = f"{columns()}, duration_mins, duration_flag"
ORACLES["write_clean"] = query(
    f"SELECT {CLEAN_COLUMNS}, strftime(tpep_pickup_datetime, '%Y-%m') AS pickup_month FROM c", *CLEAN_STEPS
)
ORACLES["save_report"] = query(
    stack(
        [
            f"'{name}' AS table_name, ({rows})::BIGINT AS n_rows"
            for name, rows in {
                "ts_headline": "5 + 0 * count(*)",
                "ts_by_vendor": "count(DISTINCT VendorID)",
                "ts_range_by_vendor": "count(DISTINCT VendorID)",
                "negative_headline": "1 + 0 * count(*)",
                "negative_by_vendor": "count(DISTINCT VendorID)",
                "negative_examples": "sum((secs < 0 AND secs <= (SELECT max(secs) FROM (SELECT secs FROM t"
                " WHERE secs < 0 ORDER BY secs LIMIT 5)))::INT)",
                "zero_headline": "1 + 0 * count(*)",
                "zero_by_vendor": "count(DISTINCT VendorID)",
                "zero_vs_rest_payment": "count(DISTINCT (secs = 0, payment_type))",
                "issues_by_vendor": "count(DISTINCT VendorID)",
            }.items()
        ],
        "t",
    )
)

# --- profile
ORACLES["table_shape"] = query("SELECT count(*) AS n_rows, 22 AS n_columns FROM t")
TYPES = dict.fromkeys(COLUMNS, "int") | dict.fromkeys(MONEY, "decimal(12,2)")
TYPES |= {
    "trip_id": "bigint",
    "passenger_count": "bigint",
    "trip_distance": "double",
    "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz",
    "store_and_fwd_flag": "string",
    "source_month": "string",
}
ORACLES["column_types"] = query(
    stack([f"'{c}' AS variable, '{t}' AS type, count({c}) AS filled" for c, t in TYPES.items()], "t")
)
for name, col, where in (
    ("freq_table_vendor", "VendorID", "TRUE"),
    ("freq_table_rate", "RatecodeID", "TRUE"),
    ("freq_table_month", "source_month", "source_month IS NOT NULL"),
    ("freq_table_rate_filled", "RatecodeID", "RatecodeID IS NOT NULL"),
):
    ORACLES[name] = query(f"SELECT {col}, count(*) AS n FROM t WHERE {where} GROUP BY {col}")
ORACLES["date_range"] = query(
    stack(
        [
            f"'{c}' AS variable, min({c}) AS earliest, max({c}) AS latest"
            for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")
        ],
        "t",
    )
)
ORACLES["null_profile"] = query(
    stack(
        [
            f"'{c}' AS variable, {cnt(f'{c} IS NULL')} AS null_count,"
            f" {pct(cnt(f'{c} IS NULL'), 'count(*)')} AS null_pct"
            for c in COLUMNS
        ],
        "t",
    )
)
ORACLES["null_share_by"] = query(
    f"SELECT VendorID, n, {whole_pct('n')} AS pct FROM"
    " (SELECT VendorID, count(*) AS n FROM t WHERE passenger_count IS NULL GROUP BY VendorID)"
)


def _null_rate(cols: tuple[str, ...]) -> str:
    rates = ", ".join(f"{pct(cnt(f'{c} IS NULL'), 'count(*)')} AS null_pct_{c}" for c in cols)
    return query(
        f"SELECT *, {whole_pct('trips')} AS pct_of_dataset FROM"
        f" (SELECT VendorID, count(*) AS trips, {rates} FROM t GROUP BY VendorID)"
    )


ORACLES["null_rate_by"] = _null_rate(
    ("passenger_count", "RatecodeID", "store_and_fwd_flag", "congestion_surcharge", "Airport_fee")
)
ORACLES["null_rate_by_two"] = _null_rate(("passenger_count", "RatecodeID"))
ORACLES["null_trend"] = query(
    "SELECT source_month, count(*) AS trips, "
    + ", ".join(
        f"{cnt(f'{c} IS NULL')} AS null_{c}, {pct(cnt(f'{c} IS NULL'), 'count(*)')} AS null_pct_{c}"
        for c in ("passenger_count", "RatecodeID")
    )
    + " FROM t GROUP BY source_month"
)
CORE = "RatecodeID IS NULL AND store_and_fwd_flag IS NULL AND congestion_surcharge IS NULL"
ORACLES["null_overlap"] = query(
    f"SELECT {cnt(CORE)} AS core, {cnt(CORE + ' AND Airport_fee IS NULL')} AS core_and_fee,"
    f" {cnt(CORE + ' AND Airport_fee IS NULL AND passenger_count IS NULL')} AS core_fee_and_passengers,"
    f" {cnt(CORE + ' AND Airport_fee IS NOT NULL')} AS core_with_fee_present,"
    f" {cnt('passenger_count IS NULL')} - {cnt(CORE)} AS passengers_beyond_core FROM t"
)
ORACLES["null_block_by"] = query(
    f"SELECT VendorID, n, {whole_pct('n')} AS pct FROM"
    f" (SELECT VendorID, count(*) AS n FROM t WHERE {CORE} GROUP BY VendorID)"
)

# --- duplicates
SIMPLE = "tpep_pickup_datetime, tpep_dropoff_datetime, PULocationID, DOLocationID"
STRICT = f"{SIMPLE}, trip_distance, VendorID, RatecodeID, payment_type"
CONTENT = ", ".join(c for c in COLUMNS if c != "trip_id")


def _dups(keys: str) -> str:
    return (
        "d AS (SELECT * FROM (SELECT *, count(*) OVER w AS size_, min(trip_id) OVER w AS dup_group_id"
        f" FROM t WINDOW w AS (PARTITION BY {keys})) WHERE size_ > 1)"
    )


for name, keys in (("exact_dups", CONTENT), ("near_dups_simple", SIMPLE), ("near_dups_strict", STRICT)):
    ORACLES[name] = query(f"SELECT {columns()}, dup_group_id FROM d", _dups(keys))
for name, keys in (
    ("exact_dup_counts", CONTENT),
    ("full_row_dup_counts", ", ".join(COLUMNS)),
    ("repeated_ids", "trip_id"),
    ("near_dups_simple_counts", SIMPLE),
    ("near_dups_strict_counts", STRICT),
):
    ORACLES[name] = query(
        "SELECT count(*) AS n_rows, count(DISTINCT dup_group_id) AS n_groups FROM d", _dups(keys)
    )
ORACLES["dup_group_id"] = query("SELECT DISTINCT dup_group_id, size_ AS n FROM d", _dups(STRICT))

NULL_AS_ZERO = ("congestion_surcharge", "Airport_fee", "cbd_congestion_fee")
SUMS = ", ".join(
    f"coalesce(sum({c}), 0) AS sum_{c}"
    if c in NULL_AS_ZERO
    else f"CASE WHEN bool_or({c} IS NULL) THEN NULL ELSE sum({c}) END AS sum_{c}"
    for c in MONEY
)
FEATURES = (
    _dups(STRICT),
    f"p AS (SELECT dup_group_id, count(*) AS n, {cnt('fare_amount > 0')} AS n_pos_fare,"
    f" {cnt('fare_amount < 0')} AS n_neg_fare, {cnt('fare_amount = 0')} AS n_zero_fare,"
    f" min(fare_amount) AS min_fare, max(fare_amount) AS max_fare, {SUMS},"
    " first(total_amount ORDER BY trip_id) AS row1_total, last(total_amount ORDER BY trip_id) AS row2_total,"
    " first(fare_amount ORDER BY trip_id) AS row1_fare, last(fare_amount ORDER BY trip_id) AS row2_fare"
    " FROM d GROUP BY dup_group_id)",
)
CORE_ZERO = " AND ".join(
    f"abs(sum_{c}) < 0.01" for c in ("fare_amount", "extra", "mta_tax", "improvement_surcharge")
)
EXTRA_ZERO = " AND ".join(f"abs(sum_{c}) < 0.01" for c in (*NULL_AS_ZERO, "tolls_amount"))
CLASSIFIED = (
    *FEATURES,
    "q0 AS (SELECT *, n_pos_fare = 1 AND n_neg_fare = 1 AS is_opposite_sign,"
    " n_pos_fare = 2 OR n_neg_fare = 2 AS is_same_sign,"
    f" {CORE_ZERO} AS core_cancels, abs(sum_tip_amount) < 0.01 AS tip_cancels, {EXTRA_ZERO} AS surcharges_cancel,"
    " sum_total_amount - (" + " + ".join(f"sum_{c}" for c in PARTS) + ") AS total_gap FROM p)",
    """q AS (SELECT *, abs(total_gap) < 0.01 AS total_reconciles,
 CASE WHEN n > 2 THEN 'H_group_size_gt_2'
  WHEN is_same_sign THEN 'A_same_sign_double_charge'
  WHEN is_opposite_sign AND NOT core_cancels THEN 'F_partial_void_core_differs'
  WHEN is_opposite_sign AND core_cancels AND tip_cancels AND surcharges_cancel THEN 'B_exact_mirror_void'
  WHEN is_opposite_sign AND core_cancels AND NOT tip_cancels AND surcharges_cancel THEN 'C_mirror_except_tip'
  WHEN is_opposite_sign AND core_cancels AND tip_cancels AND NOT surcharges_cancel THEN 'D_mirror_except_surcharge'
  WHEN is_opposite_sign AND core_cancels AND NOT tip_cancels AND NOT surcharges_cancel THEN 'E_mirror_except_tip_and_surcharge'
  ELSE 'G_other_unclassified' END AS category FROM q0)""",
)
MEASURES = (
    "min_fare", "max_fare", *[f"sum_{c}" for c in MONEY],
    "row1_total", "row2_total", "row1_fare", "row2_fare",
)
ORACLES["pair_features"] = query(
    "SELECT dup_group_id, n, n_pos_fare, n_neg_fare, n_zero_fare, "
    + ", ".join(f"{c}::DOUBLE AS {c}" for c in MEASURES)
    + " FROM p",
    *FEATURES,
)
ORACLES["pair_classify"] = query(
    "SELECT dup_group_id, n, is_opposite_sign, is_same_sign, core_cancels, tip_cancels, surcharges_cancel,"
    " total_gap::DOUBLE AS total_gap, total_reconciles, category FROM q",
    *CLASSIFIED,
)
ORACLES["pair_category_summary"] = query(
    f"SELECT category, n_rows, CASE WHEN category LIKE 'H%' THEN NULL ELSE n_rows // 2 END AS pairs,"
    f" {whole_pct('n_rows')} AS pct_rows FROM"
    " (SELECT category, count(*) AS n_rows FROM d JOIN q USING (dup_group_id) GROUP BY category)",
    *CLASSIFIED,
)
ORACLES["neg_fare_by_category"] = query(
    f"SELECT category, count(*) AS n_rows, {cnt('fare_amount < 0')} AS negative_fares,"
    f" {cnt('fare_amount = 0')} AS zero_fares, min(fare_amount)::DOUBLE AS min_fare,"
    " max(fare_amount)::DOUBLE AS max_fare FROM d JOIN q USING (dup_group_id) GROUP BY category",
    *CLASSIFIED,
)
ORACLES["pair_reconciliation"] = query(
    f"SELECT category, count(*) AS pairs, {cnt('NOT total_reconciles')} AS mismatched,"
    f" {pct(cnt('NOT total_reconciles'), 'count(*)')} AS pct_mismatched, {med('total_gap')} AS median_gap,"
    " max(abs(total_gap))::DOUBLE AS max_abs_gap FROM q WHERE n = 2 GROUP BY category",
    *CLASSIFIED,
)
ORACLES["pair_examples"] = query(
    "SELECT category, dup_group_id, trip_id, "
    + ", ".join(
        f"{c}::DOUBLE AS {c}"
        for c in (
            "fare_amount", "tip_amount", "tolls_amount", "congestion_surcharge", "Airport_fee",
            "cbd_congestion_fee", "total_amount",
        )
    )
    + " FROM (SELECT d.*, category, dense_rank() OVER (PARTITION BY category ORDER BY dup_group_id) AS place"
    " FROM d JOIN q USING (dup_group_id)) WHERE place <= 2",
    *CLASSIFIED,
)
ORACLES["ordered_neighbours"] = query(
    "SELECT trip_id, tpep_pickup_datetime, PULocationID, "
    + ", ".join(
        f"{f}({c}) OVER (ORDER BY trip_id) AS {p}_{c}"
        for f, p in (("lag", "prev"), ("lead", "next"))
        for c in ("tpep_pickup_datetime", "PULocationID")
    )
    + " FROM t"
)
ORACLES["refund_rows"] = query("SELECT trip_id FROM refunds", *REFUNDS)
ORACLES["dispute_rows"] = query("SELECT trip_id FROM disputes", *RAW_DISPUTES)
_LEFT = "trip_id, tpep_pickup_datetime, total_amount::DOUBLE AS total_amount"
ORACLES["remove_rows"] = query(f"SELECT {_LEFT} FROM s1", *CLEAN_STEPS)
ORACLES["remove_rows_tested"] = ORACLES["remove_rows"]
ORACLES["refund_flag"] = query("SELECT trip_id, any_negative, is_refund_pair FROM f", *FLAGGED)

# --- rules
ORACLES["rule_counts"] = query(
    rules({"long": "secs > 3600", "tipped": "tip_amount > 0", "no_rate": "RatecodeID IS NULL"})
)
ORACLES["ts_window_counts"] = query(
    rules(
        {
            "pickup_before": f"tpep_pickup_datetime < {START}",
            "pickup_after": f"tpep_pickup_datetime >= {AFTER}",
            "dropoff_before": f"tpep_dropoff_datetime < {START}",
            "dropoff_after": f"tpep_dropoff_datetime >= {AFTER}",
        }
    )
)
ZERO_FARE, ZERO_DISTANCE = "secs = 0 AND fare_amount <> 0", "secs = 0 AND trip_distance <> 0"
ZERO_COLUMNS = (
    f"{cnt(ZERO_FARE)} AS {{0}}_fare, {pct(cnt(ZERO_FARE), cnt('secs = 0 AND fare_amount IS NOT NULL'))} AS {{1}}fare{{2}},"
    f" {cnt(ZERO_DISTANCE)} AS {{0}}_distance,"
    f" {pct(cnt(ZERO_DISTANCE), cnt('secs = 0 AND trip_distance IS NOT NULL'))} AS {{1}}distance{{2}},"
    f" {mean('fare_amount', ZERO_FARE)} AS mean_fare, {mean('trip_distance', ZERO_DISTANCE)} AS mean_distance"
)
ORACLES["duration_counts"] = query(
    f"SELECT {cnt('secs < 0')} AS negative, {cnt('secs = 0')} AS zero,"
    f" {ZERO_COLUMNS.format('zero_with', 'zero_with_', '_pct')} FROM t"
)
ORACLES["zero_duration_freq"] = query(
    "SELECT payment_type, count(*) AS n FROM t WHERE secs = 0 AND payment_type IS NOT NULL GROUP BY payment_type"
)
for name, col in (("mix_compare_payment", "payment_type"), ("mix_compare_vendor", "VendorID")):
    ORACLES[name] = query(
        f"SELECT {col}, coalesce(max(pct) FILTER (WHERE grp = 'zero'), 0) AS zero_duration,"
        " coalesce(max(pct) FILTER (WHERE grp = 'rest'), 0) AS rest,"
        " coalesce(max(pct) FILTER (WHERE grp = 'zero'), 0) - coalesce(max(pct) FILTER (WHERE grp = 'rest'), 0)"
        f" AS difference FROM (SELECT grp, {col}, {whole_pct('n', 'grp')} AS pct FROM"
        f" (SELECT CASE WHEN secs = 0 THEN 'zero' ELSE 'rest' END AS grp, {col}, count(*) AS n FROM t"
        f" GROUP BY ALL)) GROUP BY {col}"
    )
ORACLES["distance_duration_counts"] = query(
    rules(
        {
            "negative_distance": "trip_distance < 0",
            "zero_distance_with_duration": "trip_distance = 0 AND secs > 0",
            "zero_duration_with_distance": "secs = 0 AND trip_distance > 0",
        }
    )
)
RATES, FLAGS, PAYMENTS = "(1, 2, 3, 4, 5, 6, 99)", "('Y', 'N')", "(0, 1, 2, 3, 4, 5, 6)"


def _violations(valid: dict[str, str]) -> str:
    return query(
        stack(
            [
                f"'{c}' AS variable, count({c}) AS filled, {cnt(f'{c} NOT IN {v}')} AS invalid,"
                f" {pct(cnt(f'{c} NOT IN {v}'), 'count(*)')} AS invalid_pct"
                for c, v in valid.items()
            ],
            "t",
        )
    )


ORACLES["code_violations"] = _violations(
    {"RatecodeID": RATES, "store_and_fwd_flag": FLAGS, "payment_type": PAYMENTS}
)
ORACLES["code_violations_narrow"] = _violations(
    {"RatecodeID": "(1, 2, 3, 4, 5, 6)", "store_and_fwd_flag": "('N')", "payment_type": "(1, 2)"}
)
for name, col, valid in (
    ("code_breakdown_rate", "RatecodeID", RATES),
    ("code_breakdown_flag", "store_and_fwd_flag", FLAGS),
    ("code_breakdown_payment", "payment_type", PAYMENTS),
):
    ORACLES[name] = query(
        f"SELECT {col}, count(*) AS n, {col} IN {valid} AS is_valid FROM t WHERE {col} IS NOT NULL GROUP BY {col}"
    )
ORACLES["negative_counts"] = query(rules({c: f"{c} < 0" for c in MONEY}, "variable"))
TOTAL_GAP = (
    "(total_amount - (fare_amount + extra + mta_tax + tip_amount + tolls_amount + improvement_surcharge"
    " + coalesce(congestion_surcharge, 0) + coalesce(Airport_fee, 0) + cbd_congestion_fee))"
)
ORACLES["total_mismatch"] = query(rules({"total_mismatch": f"abs({TOTAL_GAP}) > 0.01"}))
ORACLES["total_mismatch_top"] = query(
    f"SELECT ({TOTAL_GAP})::DOUBLE AS gap, count(*) AS n FROM t WHERE abs({TOTAL_GAP}) > 0.01"
    " GROUP BY gap ORDER BY n DESC, gap LIMIT 5"
)
MOST = "(3.0::DOUBLE + 3.5::DOUBLE * trip_distance + 0.7::DOUBLE * mins)"
LEAST = "(3.0::DOUBLE + 3.5::DOUBLE * trip_distance)"
ORACLES["fare_formula_flags"] = query(
    rules(
        {
            "standard_above_max": f"RatecodeID = 1 AND fare_amount::DOUBLE > {MOST}",
            "standard_severe_under": f"RatecodeID = 1 AND {LEAST} > 3 AND fare_amount::DOUBLE < {LEAST} * 0.8::DOUBLE",
            "jfk_not_flat": "RatecodeID = 2 AND fare_amount > 0 AND abs(fare_amount - 70) > 0.5",
            "newark_below_min": "RatecodeID = 3 AND fare_amount > 0 AND fare_amount < 23",
        },
        source="(SELECT * FROM t WHERE fare_amount IS NOT NULL AND mins > 0 AND trip_distance > 0)",
    )
)
ORACLES["tip_checks"] = query(
    f"SELECT {cnt('payment_type = 2 AND tip_amount > 0')} AS cash_with_tip,"
    f" {cnt('payment_type = 0 AND tip_amount > 0')} AS flex_with_tip,"
    f" {mean('tip_amount', 'payment_type = 0 AND tip_amount > 0')} AS mean_flex_tip,"
    f" {mean('tip_amount', 'payment_type = 1 AND tip_amount > 0')} AS mean_card_tip FROM t"
)
ORACLES["mta_zero_subgroups"] = query(
    "SELECT CASE WHEN fare_amount = 0 THEN 'fare_zero_likely_voided' WHEN fare_amount < 0 THEN 'fare_negative_reversal'"
    " WHEN payment_type = 3 THEN 'no_charge_trip' WHEN payment_type = 4 THEN 'dispute_trip'"
    " WHEN fare_amount > 0 AND payment_type BETWEEN 0 AND 2 THEN 'genuine_anomaly' ELSE 'other' END AS subgroup,"
    " count(*) AS n FROM t WHERE mta_tax = 0 AND RatecodeID = 1 GROUP BY subgroup"
)
WRONG_ZONE = "(Airport_fee > 0 AND (PULocationID IS NULL OR PULocationID NOT IN (132, 138)))"
WRONG_FEE = "(Airport_fee > 0 AND Airport_fee NOT IN (1.25, 1.75))"
ORACLES["airport_fee_anomalies"] = query(
    rules({"wrong_zone": WRONG_ZONE, "wrong_amount": WRONG_FEE, "either": f"{WRONG_ZONE} OR {WRONG_FEE}"})
)
ORACLES["airport_fee_top_zones"] = query(
    f"SELECT PULocationID, count(*) AS n FROM t WHERE {WRONG_ZONE} GROUP BY PULocationID"
    " ORDER BY n DESC, PULocationID LIMIT 5"
)
ORACLES["airport_fee_amounts"] = query(
    f"SELECT Airport_fee::DOUBLE AS Airport_fee, count(*) AS n FROM t WHERE {WRONG_FEE} GROUP BY Airport_fee"
)
ORACLES["airport_fee_amounts_one_fee"] = query(
    "SELECT Airport_fee::DOUBLE AS Airport_fee, count(*) AS n FROM t WHERE Airport_fee > 0 AND Airport_fee <> 1.25"
    " GROUP BY Airport_fee"
)
ORACLES["airport_fee_zone_vendors"] = query(
    f"SELECT VendorID, n, {whole_pct('n')} AS pct FROM (SELECT VendorID, count(*) AS n FROM t"
    f" WHERE {WRONG_ZONE} AND PULocationID = 70 GROUP BY VendorID)"
)
ORACLES["policy_counts"] = query(
    rules(
        {
            "cbd_fee_before_policy": f"tpep_pickup_datetime < {POLICY} AND cbd_congestion_fee <> 0",
            "improvement_old": "improvement_surcharge = 0.30",
            "improvement_current": "improvement_surcharge = 1",
            "improvement_reversed": "improvement_surcharge = -1",
        }
    )
)
ORACLES["unknown_zone_counts"] = query(
    rules({"pickup_unknown": "PULocationID IN (264, 265)", "dropoff_unknown": "DOLocationID IN (264, 265)"})
)
ORACLES["rate_check_flat"] = query(
    f"SELECT VendorID, count(*) AS trips, {cnt('fare_amount = 70')} AS at_flat_fare,"
    f" {cnt('fare_amount <> 70')} AS off_flat_fare, {pct(cnt('fare_amount = 70'), 'count(*)')} AS pct_at_flat_fare,"
    f" {mean('fare_amount', 'fare_amount <> 70')} AS mean_fare_when_off FROM t WHERE RatecodeID = 2 GROUP BY VendorID"
)
ORACLES["rate_check_standard"] = query(
    "SELECT VendorID, count(*) AS trips, "
    + ", ".join(
        f"{cnt(c)} AS {n}, {pct(cnt(c), 'count(*)')} AS pct_{n}"
        for n, c in {
            "fare_below_initial": "fare_amount < 3",
            "fare_negative": "fare_amount < 0",
            "mta_tax_off": "mta_tax <> 0.5",
            "improvement_off": "improvement_surcharge <> 1",
        }.items()
    )
    + " FROM t WHERE RatecodeID = 1 GROUP BY VendorID"
)
ORACLES["rate_check_newark"] = query(
    f"SELECT VendorID, count(*) AS trips, {cnt('fare_amount < 3')} AS fare_below_initial,"
    f" {pct(cnt('fare_amount < 3'), 'count(*)')} AS pct_fare_below_initial, {cnt('tolls_amount = 0')} AS zero_tolls,"
    f" {pct(cnt('tolls_amount = 0'), 'count(*)')} AS pct_zero_tolls, {mean('fare_amount')} AS mean_fare,"
    f" {mean('tolls_amount')} AS mean_tolls FROM t WHERE RatecodeID = 3 GROUP BY VendorID"
)
ORACLES["rate_check_negotiated"] = query(
    f"SELECT VendorID, count(*) AS trips, {cnt('fare_amount <= 0')} AS fare_not_positive,"
    f" {pct(cnt('fare_amount <= 0'), 'count(*)')} AS pct_fare_not_positive, {mean('fare_amount')} AS mean_fare,"
    f" {med('fare_amount')} AS median_fare, max(fare_amount)::DOUBLE AS max_fare"
    " FROM t WHERE RatecodeID = 5 GROUP BY VendorID"
)
NO_CBD = (
    "abs(total_amount - (fare_amount + extra + mta_tax + tip_amount + tolls_amount + improvement_surcharge"
    " + congestion_surcharge + Airport_fee))"
)
ORACLES["total_check_by"] = query(
    f"SELECT VendorID, RatecodeID, count(*) AS trips, {cnt(f'{NO_CBD} >= 0.01')} AS mismatches,"
    f" {pct(cnt(f'{NO_CBD} >= 0.01'), 'count(*)')} AS pct_mismatches,"
    f" {mean(NO_CBD, f'{NO_CBD} >= 0.01')} AS mean_gap_when_off"
    " FROM t WHERE RatecodeID IS NOT NULL GROUP BY VendorID, RatecodeID"
)
ORACLES["negative_matrix"] = query(
    " UNION ALL ".join(
        f"SELECT payment_type, '{c}' AS variable, count(*) AS trips, {cnt(f'{c} < 0')} AS negative,"
        f" {pct(cnt(f'{c} < 0'), 'count(*)')} AS negative_pct, {mean(c, f'{c} < 0')} AS mean_when_negative"
        " FROM t WHERE payment_type IN (0, 3, 4, 6) GROUP BY payment_type"
        for c in MONEY
        if c != "cbd_congestion_fee"
    )
)

# --- outliers
_METHODS = {
    "iqr_1.5": "q3 + 1.5::DOUBLE * (q3 - q1)",
    "iqr_3": "q3 + 3.0::DOUBLE * (q3 - q1)",
    "p99": "p99",
    "p99.9": "p999",
    "p99.95": "p9995",
    "p99.99": "p9999",
}
ORACLES["outlier_thresholds"] = query(
    "SELECT variable, method, round(cutoff, 9) AS cutoff, count(*) FILTER (WHERE v > cutoff) AS n_above FROM vals JOIN limits"
    " USING (variable) GROUP BY variable, method, cutoff",
    "vals AS (SELECT 'trip_distance' AS variable, trip_distance AS v FROM t WHERE trip_distance >= 0"
    " UNION ALL SELECT 'duration_min', mins FROM t WHERE mins > 0"
    " UNION ALL SELECT 'total_amount', total_amount::DOUBLE FROM t WHERE total_amount >= 0)",
    f"qs AS (SELECT variable, {med('v', q=0.25)} AS q1, {med('v', q=0.75)} AS q3, {med('v', q=0.99)} AS p99,"
    f" {med('v', q=0.999)} AS p999, {med('v', q=0.9995)} AS p9995, {med('v', q=0.9999)} AS p9999"
    " FROM vals GROUP BY variable)",
    "limits AS ("
    + " UNION ALL ".join(f"SELECT variable, '{m}' AS method, {e} AS cutoff FROM qs" for m, e in _METHODS.items())
    + ")",
)
ORACLES["domain_thresholds"] = query(
    stack(
        [
            f"'{v}' AS variable, {t}::DOUBLE AS threshold, {cnt(f'{x} > {t}')} AS n_above, max({x})::DOUBLE AS largest"
            for v, x, ts in (
                ("trip_distance", "trip_distance", (100, 200)),
                ("fare_amount", "fare_amount", (200, 500)),
                ("total_amount", "total_amount", (200, 500)),
                ("duration_min", "mins", (480,)),
            )
            for t in ts
        ],
        "t",
    )
)

# --- re-cleaning, footers, orders by other keys, sketches
ORACLES["rewrite_month"] = ORACLES["write_clean"]
ORACLES["footer_profile"] = query(
    stack(
        [
            f"'{c}' AS variable, count(*) AS n_rows, {cnt(f'{c} IS NULL')} AS null_count,"
            f" {pct(cnt(f'{c} IS NULL'), 'count(*)')} AS null_pct"
            for c in COLUMNS
        ],
        "t",
    )
)
ORACLES["footer_ranges"] = query(
    stack(
        [
            f"'{c}' AS variable, min({c})::DOUBLE AS smallest, max({c})::DOUBLE AS largest"
            for c in ("trip_id", "VendorID", "passenger_count", "trip_distance", "RatecodeID", "PULocationID", "DOLocationID", "payment_type", *MONEY)
        ],
        "t",
    )
)
ORACLES["neighbours_in_order"] = query(
    "SELECT trip_id, tpep_pickup_datetime, passenger_count, total_amount::DOUBLE AS total_amount, "
    + ", ".join(
        f"{f}({c}) OVER (ORDER BY passenger_count NULLS FIRST, tpep_pickup_datetime NULLS FIRST, trip_id)::{t} AS {p}_{c}"
        for f, p in (("lag", "prev"), ("lead", "next"))
        for c, t in (("trip_id", "BIGINT"), ("total_amount", "DOUBLE"))
    )
    + " FROM t"
)
# A sketch is right if its quantiles are within the stated error; how many values there are is exact.
ORACLES["outlier_sketches"] = query(
    "SELECT variable, prob::DOUBLE AS prob, count(*) AS n, TRUE AS within FROM vals CROSS JOIN"
    " unnest([0.25, 0.5, 0.75, 0.99, 0.999, 0.9995, 0.9999]) p(prob) GROUP BY variable, prob",
    "vals AS (SELECT 'trip_distance' AS variable, trip_distance AS v FROM t WHERE trip_distance >= 0"
    " UNION ALL SELECT 'duration_min', mins FROM t WHERE mins > 0"
    " UNION ALL SELECT 'total_amount', total_amount::DOUBLE FROM t WHERE total_amount >= 0)",
)
