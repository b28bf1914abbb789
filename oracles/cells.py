"""Oracles for sets of tables: the cells of the single oracles, one row per cell."""

from __future__ import annotations

from oracles import business, studies

# Table, its oracle, the columns that name its rows, its numbers, its texts.
DISCREPANCY = (
    ("overall", "discrepancy_overall", "", "trips discrepant exact pct_discrepant mean sd p5 p25 median p75 p95 p99 min max", ""),
    ("buckets", "discrepancy_buckets", "band", "position n pct_of_rows pct_of_discrepant", ""),
    ("signs", "discrepancy_signs", "sign", "n pct", ""),
    ("by_payment", "discrepancy_by_payment", "payment", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("cash_tips", "cash_tip_recon", "", "cash_rows plausible_tip median_plausible_tip", ""),
    ("by_vendor", "discrepancy_by_vendor", "vendor", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("components", "component_diagnosis", "component", "n_zero pct_zero n_null pct_null n_negative", ""),
    ("by_month", "discrepancy_by_month", "pickup_month", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("medium_band", "medium_band_eras", "", "rows_in_band pre_cbd post_cbd", ""),
    ("modal_values", "modal_values", "discrepancy::DECIMAL(14,2)", "n pct_of_band", ""),
    ("modal_values_by_vendor", "modal_values_by_vendor", "vendor place", "discrepancy n", ""),
    ("modal_values_by_era", "modal_values_by_era", "era place", "discrepancy n", ""),
    ("top_gaps", "top_gaps", "trip_id", "VendorID payment_type fare_amount tip_amount total_amount discrepancy expected_discrepancy", "tpep_pickup_datetime"),
    ("rate_changed_crosstab", "rate_changed_crosstab", "rate_changed has_discrepancy", "n pct_within", ""),
    ("rate_changed_summary", "rate_changed_summary", "rate_changed", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("rate_changed_pairs", "rate_changed_pairs", "RatecodeID implied_rate", "trips discrepant pct_discrepant", ""),
    ("zones_by_pickup", "discrepancy_zone_top_pickup_100", "PULocationID", "trips discrepant pct_discrepant median_gap", ""),
    ("zones_by_dropoff", "discrepancy_zone_top_dropoff_100", "DOLocationID", "trips discrepant pct_discrepant median_gap", ""),
    ("zones_by_rate", "discrepancy_zone_top_rate_100", "PULocationID", "trips discrepant pct_discrepant median_gap", ""),
    ("by_hour", "discrepancy_by_hour", "pickup_hour", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("congestion_match", "congestion_match", "", "discrepant matching pct_matching", ""),
    ("congestion_inverse", "congestion_inverse", "has_discrepancy", "trips pct_zero_surcharge median_surcharge mean_surcharge", ""),
    ("congestion_vendor", "congestion_vendor", "vendor", "n pct", ""),
    ("by_daypart_zone", "discrepancy_by_daypart_zone", "zone part_of_day", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("by_zone_group", "discrepancy_by_zone_group", "zone", "trips discrepant pct_discrepant median_gap mean_gap", ""),
    ("by_rate", "discrepancy_by_rate", "rate", "trips discrepant pct_discrepant median_gap mean_gap", ""),
)
NEGATIVE = (
    ("any_negative", "any_negative", "", "trips any_negative", ""),
    ("negative_vs_refund", "negative_vs_refund", "", "refund_rows negative_in_refund negative_outside", ""),
    ("refund_sides", "refund_sides", "side", "n pct", ""),
    ("by_payment", "negative_by_payment", "payment", "n pct", ""),
    ("by_vendor", "negative_by_vendor", "vendor", "n pct", ""),
    ("orphans", "orphan_negatives", "", "orphans median_total mean_total median_fare mean_fare", ""),
    ("orphans_by_payment", "orphan_by_payment", "payment", "n pct", ""),
    ("by_column", "negative_by_column_split", "variable", "negative in_refund orphan pct_in_refund", ""),
    ("monthly", "negative_monthly", "pickup_month", "n", ""),
)
FLAGS = "pickup_before_window pickup_after_window dropoff_before_window dropoff_after_window any_ts_issue"
ISSUES = "out_of_range negative_duration zero_duration any_issue"
DURATION = (
    ("ts_headline", "ts_headline", "issue", "n pct", ""),
    ("ts_by_vendor", "ts_by_vendor", "vendor", f"trips {FLAGS} pct_any_ts_issue", ""),
    ("ts_range_by_vendor", "ts_range_by_vendor", "vendor", "", "earliest_pickup latest_pickup earliest_dropoff latest_dropoff"),
    ("negative_headline", "neg_duration_headline", "", "negative pct most_negative median_mins", ""),
    ("negative_by_vendor", "neg_duration_by_vendor", "vendor", "trips negative pct most_negative median_mins mean_fare", ""),
    ("negative_examples", "neg_duration_examples", "trip_id", "duration_mins fare_amount total_amount payment_type", "vendor tpep_pickup_datetime tpep_dropoff_datetime"),
    ("zero_headline", "zero_duration_headline", "", "zero pct with_fare with_distance pct_with_fare pct_with_distance mean_fare mean_distance", ""),
    ("zero_by_vendor", "zero_duration_by_vendor", "vendor", "trips zero pct with_fare with_distance mean_fare", ""),
    ("zero_vs_rest_payment", "zero_vs_rest_payment", "trip_group payment", "n pct_within", ""),
    ("issues_by_vendor", "issues_by_vendor", "vendor", f"trips {ISSUES} {' '.join('pct_' + i for i in ISSUES.split())}", ""),
)
SUMMARIES = (
    (
        "00_kpi", "kpi_summary", "",
        "total_trips total_revenue avg_total_amount median_total_amount avg_fare_amount avg_trip_distance avg_duration_min"
        " avg_tip_amount credit_card_share cash_share airport_pickup_share cbd_positive_share", "",
    ),
    ("U01_trips_by_date", "trips_by_date", "pickup_date::DATE", "trips", ""),
    ("U02_trips_by_month", "trips_by_month", "pickup_month_label", "trips", ""),
    ("U07_passenger_count", "passenger_freq", "passenger_count", "trips", ""),
    ("U08_payment_type", "label_freq_payment", "payment_label", "trips share", ""),
    ("U09_ratecode", "label_freq_rate", "rate_label", "trips share", ""),
    ("B01_trips_by_hour", "trips_by_hour", "pickup_hour", "trips", ""),
    ("B02_weekday_demand", "weekday_demand", "pickup_weekday", "trips", ""),
    ("B03_payment_behavior", "payment_behavior", "payment_label", "trips avg_tip median_tip avg_total median_total", ""),
    ("B06_zones_by_trips", "top_zones_trips", "PULocationID", "trips", ""),
    ("B07_zones_by_revenue", "top_zones_revenue", "PULocationID", "trips total_revenue avg_total", ""),
    ("M01_month_hour", "demand_matrix_month_hour", "pickup_month_label pickup_hour", "trips", ""),
    ("M02_weekday_hour", "demand_matrix_weekday_hour", "pickup_weekday pickup_hour", "trips", ""),
    ("M03_zone_hour", "zone_hour_demand", "PULocationID pickup_hour", "trips", ""),
    ("M04_zone_payment", "zone_payment_revenue", "PULocationID payment_label", "trips total_revenue avg_total", ""),
    ("M05_distance_duration", "band_matrix", "distance_band duration_band", "trips avg_total_amount", ""),
    ("M06_policy", "policy_pre_post", "cbd_period", "trips avg_total_amount total_cbd_fee avg_cbd_fee cbd_positive_share", ""),
    ("zone_revenue", "zone_revenue", "PULocationID", "trips total_revenue avg_revenue", ""),
)


def _cells(tables: tuple) -> str:
    single = {**studies.ORACLES, **business.ORACLES}
    parts = []
    for name, oracle, keys, numbers, texts in tables:
        key = " || ' | ' || ".join(f"coalesce(({k})::VARCHAR, 'null')" for k in keys.split()) or "'all'"
        found = [f"{{'measure': '{c}', 'value': ({c})::DOUBLE, 'text': NULL::VARCHAR}}" for c in numbers.split()]
        found += [f"{{'measure': '{c}', 'value': NULL::DOUBLE, 'text': ({c})::VARCHAR}}" for c in texts.split()]
        parts.append(f"SELECT '{name}' AS table_name, {key} AS row_key, unnest([{', '.join(found)}]) AS cell FROM ({single[oracle]})")
    return f"SELECT table_name, row_key, cell.measure AS measure, cell.value AS value, cell.text AS text FROM ({' UNION ALL '.join(parts)})"


ORACLES = {
    "save_discrepancy_study": _cells(DISCREPANCY),
    "save_negative_study": _cells(NEGATIVE),
    "save_duration_study": _cells(DURATION),
    "write_read_summaries": _cells(SUMMARIES),
}
