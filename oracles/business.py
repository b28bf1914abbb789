"""Oracles for the cleaning steps, dashboards and zones."""

from __future__ import annotations

from oracles.base import (
    CLEAN_STEPS,
    END,
    ODD_DURATION,
    PARTS,
    POLICY,
    START,
    ZONES,
    case,
    cnt,
    columns,
    mean,
    med,
    pct,
    query,
    total,
    whole_pct,
)

ORACLES: dict[str, str] = {}
LEFT = "trip_id, tpep_pickup_datetime, total_amount::DOUBLE AS total_amount"
KEPT = (
    "trip_id, VendorID, tpep_pickup_datetime, fare_amount::DOUBLE AS fare_amount, total_amount::DOUBLE AS total_amount"
)

# --- cleaning
ORACLES["clean_trips"] = query(
    f"SELECT {columns()}, duration_mins, duration_flag FROM c", *CLEAN_STEPS
)
ORACLES["clean_step_1_refunds"] = query(f"SELECT {LEFT} FROM s1", *CLEAN_STEPS)
ORACLES["clean_step_2_disputes"] = query(f"SELECT {LEFT} FROM s2", *CLEAN_STEPS)
ORACLES["clean_step_5_duration_flag"] = query(f"SELECT trip_id, {ODD_DURATION} AS duration_flag FROM t")
for name, keep in {
    "clean_step_3_pickup": f"tpep_pickup_datetime >= {START} AND tpep_pickup_datetime <= {END}",
    "clean_step_4_dropoff": f"tpep_dropoff_datetime >= {START}",
    "clean_step_6_distance": "trip_distance > 0 AND trip_distance < 100",
    "clean_step_7_long": "secs IS NULL OR secs <= 10800",
    "clean_step_8_zone": "(PULocationID > 263 OR DOLocationID > 263) IS NOT TRUE",
    "clean_step_9_fare": "(fare_amount < 3 OR fare_amount > 500 OR (RatecodeID = 1 AND fare_amount < 4)"
    " OR fare_amount > total_amount) IS NOT TRUE",
    "clean_step_10_fare_distance": "fare_amount >= 3 AND fare_amount <= 250 AND NOT (RatecodeID = 1 AND fare_amount < 4)"
    " AND fare_amount <= total_amount AND trip_distance > 0 AND trip_distance <= 100",
    "clean_step_12_total": "total_amount >= 5 AND total_amount <= 500",
}.items():
    ORACLES[name] = query(f"SELECT {KEPT} FROM t WHERE {keep}")
ORACLES["clean_steps_11_13_14_repair"] = query(
    "SELECT trip_id, extra::DOUBLE AS extra, Airport_fee::DOUBLE AS Airport_fee,"
    f" congestion_surcharge::DOUBLE AS congestion_surcharge, ({' + '.join(PARTS)})::DOUBLE AS total_amount FROM"
    " (SELECT * REPLACE ("
    + ", ".join(f"coalesce({p}, 0)::DECIMAL(12,2) AS {p}" for p in PARTS)
    + ") FROM (SELECT * REPLACE (CASE WHEN extra < 0 AND fare_amount >= 0 THEN 0 ELSE extra END AS extra,"
    " CASE WHEN PULocationID IN (132, 138, 1) THEN 1.75 ELSE 0 END AS Airport_fee) FROM t))"
)
STEPS = {
    1: ("refund pair", "t", "s1", None),
    2: ("adjacent dispute", "s1", "s2", None),
    3: ("pickup outside the period", "s2", "s3", None),
    4: ("dropoff before the period", "s3", "s4", None),
    5: ("odd duration flagged", "s4", "s5", "SELECT count(*) FROM s5 WHERE duration_flag"),
    6: ("distance not in (0, 100)", "s5", "s6", None),
    7: ("longer than three hours", "s6", "s7", None),
    8: ("zone above 263", "s7", "s8", None),
    9: ("fare out of limits", "s8", "s9", None),
    10: ("fare and distance not consistent", "s9", "s10", None),
    11: (
        "negative extra set to zero",
        "s10",
        "s11",
        "SELECT count(*) FROM s10 WHERE extra < 0 AND fare_amount >= 0",
    ),
    12: ("total out of limits", "s11", "s12", None),
    13: (
        "airport fee set from pickup zone",
        "s12",
        "s13",
        "SELECT count(*) FROM s12 WHERE PULocationID IN (132, 138, 1)",
    ),
    14: ("nulls set to zero, total recomputed", "s13", "c", "SELECT count(*) FROM c"),
}
ORACLES["cleaning_report"] = query(
    " UNION ALL ".join(
        f"SELECT {step} AS step, '{label}' AS label, (SELECT count(*) FROM {a}) AS before,"
        f" (SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b}) AS dropped,"
        f" (SELECT count(*) FROM {b}) AS remaining, ({touched or 'NULL'})::BIGINT AS touched"
        for step, (label, a, b, touched) in STEPS.items()
    ),
    *CLEAN_STEPS,
)
ORACLES["cleaning_total"] = query(
    "SELECT original, final, original - final AS dropped,"
    f" {pct('original - final', 'original')} AS pct_dropped, flagged_kept FROM"
    " (SELECT (SELECT count(*) FROM t) AS original, (SELECT count(*) FROM c) AS final,"
    " (SELECT count(*) FROM c WHERE duration_flag) AS flagged_kept)",
    *CLEAN_STEPS,
)
ORACLES["revenue_by_vendor"] = query(
    "SELECT VendorID, revenue_before, revenue_after FROM (SELECT VendorID, sum(total_amount)::DOUBLE AS revenue_before"
    " FROM t GROUP BY VendorID) FULL JOIN (SELECT VendorID, sum(total_amount)::DOUBLE AS revenue_after FROM c"
    " GROUP BY VendorID) USING (VendorID)",
    *CLEAN_STEPS,
)


def _adjusted(source: str) -> str:
    r2 = f"(SELECT regr_r2(trip_distance, fare_amount::DOUBLE) FROM {source})"
    n = f"(SELECT regr_count(trip_distance, fare_amount::DOUBLE)::DOUBLE FROM {source})"
    return f"1 - (1 - {r2}) * ({n} - 1) / ({n} - 2)"


ORACLES["fit_quality"] = query(
    "SELECT round((SELECT corr(trip_distance, fare_amount::DOUBLE) FROM s10), 9) AS corr_after_step_10,"
    " round((SELECT corr(trip_distance, fare_amount::DOUBLE) FROM c), 9) AS corr_final,"
    f" round({_adjusted('t')}, 9) AS adj_r2_before, round({_adjusted('c')}, 9) AS adj_r2_after",
    *CLEAN_STEPS,
)

# --- dashboards
PAYMENT = {
    0: "Flex Fare", 1: "Credit Card", 2: "Cash", 3: "No Charge", 4: "Dispute", 5: "Unknown", 6: "Voided",
}
RATE = {
    1: "Standard", 2: "JFK", 3: "Newark", 4: "Nassau/Westchester", 5: "Negotiated", 6: "Group Ride", 99: "Unknown",
}
PAYMENT_LABEL = case("payment_type", PAYMENT, "Missing/Invalid")
RATE_LABEL = case("RatecodeID", RATE, "Missing/Invalid")
DATE = "tpep_pickup_datetime::DATE"
MONTH = "strftime(tpep_pickup_datetime, '%Y-%m')"
HOUR = "hour(tpep_pickup_datetime)::INT"
WEEKDAY = "dayname(tpep_pickup_datetime)"
ORACLES["add_calendar"] = query(
    f"SELECT trip_id, {DATE} AS pickup_date, date_trunc('month', tpep_pickup_datetime)::TIMESTAMP AS pickup_month,"
    f" {MONTH} AS pickup_month_label, {HOUR} AS pickup_hour, {WEEKDAY} AS pickup_weekday, mins AS duration_min,"
    f" {DATE} >= DATE '2025-01-05' AS is_post_cbd FROM t"
)
ORACLES["add_labels"] = query(
    f"SELECT trip_id, {PAYMENT_LABEL} AS payment_label, {RATE_LABEL} AS rate_label FROM t"
)


def _kpis(source: str) -> str:
    return (
        f"SELECT count(*) AS total_trips, {total('total_amount')} AS total_revenue,"
        f" {mean('total_amount')} AS avg_total_amount, {med('total_amount')} AS median_total_amount,"
        f" {mean('fare_amount')} AS avg_fare_amount, {mean('trip_distance')} AS avg_trip_distance,"
        f" {mean('secs')} / 60.0::DOUBLE AS avg_duration_min, {mean('tip_amount')} AS avg_tip_amount,"
        " sum((payment_type = 1)::INT)::DOUBLE / count(payment_type)::DOUBLE AS credit_card_share,"
        " sum((payment_type = 2)::INT)::DOUBLE / count(payment_type)::DOUBLE AS cash_share,"
        f" {cnt('PULocationID IN (132, 138)')}::DOUBLE / count(*)::DOUBLE AS airport_pickup_share,"
        f" {cnt('cbd_congestion_fee > 0')}::DOUBLE / count(cbd_congestion_fee)::DOUBLE AS cbd_positive_share"
        f" FROM {source}"
    )


ORACLES["kpi_summary"] = query(_kpis("c"), *CLEAN_STEPS)
ORACLES["write_read_summary"] = query(_kpis("t"))


def _counts(**keys: str) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in keys.items())
    return query(f"SELECT {cols}, count(*) AS trips FROM c GROUP BY ALL", *CLEAN_STEPS)


ORACLES["trips_by_date"] = _counts(pickup_date=DATE)
ORACLES["trips_by_month"] = _counts(pickup_month_label=MONTH)
ORACLES["trips_by_hour"] = _counts(pickup_hour=HOUR)
ORACLES["weekday_demand"] = _counts(pickup_weekday=WEEKDAY)
ORACLES["demand_matrix_month_hour"] = _counts(pickup_month_label=MONTH, pickup_hour=HOUR)
ORACLES["demand_matrix_weekday_hour"] = _counts(pickup_weekday=WEEKDAY, pickup_hour=HOUR)
ORACLES["passenger_freq"] = query(
    "SELECT passenger_count, count(*) AS trips FROM c WHERE passenger_count IS NOT NULL GROUP BY passenger_count",
    *CLEAN_STEPS,
)
for name, value in {
    "histogram_distance": "trip_distance",
    "histogram_duration": "secs",
    "histogram_fare": "fare_amount::DOUBLE",
    "histogram_total": "total_amount::DOUBLE",
}.items():
    unit = "60.0::DOUBLE" if value == "secs" else "1.0::DOUBLE"
    ORACLES[name] = query(
        f"SELECT bin, round((low + bin * width) / {unit}, 9) AS low, round((low + (bin + 1) * width) / {unit}, 9) AS high, n FROM (SELECT"
        " coalesce(least(floor((v - low) / nullif(width, 0)), 59), 0)::INT AS bin, min(low) AS low, min(width) AS width,"
        " count(*) AS n FROM (SELECT v, low, (cap - low) / 60.0::DOUBLE AS width, cap FROM vals,"
        f" (SELECT min(v) AS low, {med('v', q=0.99)} AS cap FROM vals)) WHERE v <= cap GROUP BY 1)",
        *CLEAN_STEPS,
        f"vals AS (SELECT {value} AS v FROM c WHERE {value} >= 0)",
    )
for name, alias, label in (
    ("label_freq_payment", "payment_label", PAYMENT_LABEL),
    ("label_freq_rate", "rate_label", RATE_LABEL),
):
    ORACLES[name] = query(
        f"SELECT {alias}, trips, {whole_pct('trips')} / 100.0::DOUBLE AS share FROM"
        f" (SELECT {label} AS {alias}, count(*) AS trips FROM c GROUP BY ALL)",
        *CLEAN_STEPS,
    )
ORACLES["payment_behavior"] = query(
    f"SELECT {PAYMENT_LABEL} AS payment_label, count(*) AS trips, {mean('tip_amount')} AS avg_tip,"
    f" {med('tip_amount')} AS median_tip, {mean('total_amount')} AS avg_total, {med('total_amount')} AS median_total"
    " FROM c GROUP BY ALL",
    *CLEAN_STEPS,
)
ORACLES["sample_points"] = query(
    "SELECT trip_id, trip_distance, total_amount::DOUBLE AS total_amount FROM c"
    f" WHERE trip_distance >= 0 AND total_amount >= 0 AND trip_distance <= (SELECT {med('trip_distance', 'trip_distance >= 0', 0.99)} FROM c)"
    f" AND total_amount::DOUBLE <= (SELECT {med('total_amount', 'total_amount >= 0', 0.99)} FROM c)"
    " ORDER BY md5(trip_id::VARCHAR || ':123'), trip_id LIMIT 100000",
    *CLEAN_STEPS,
)
KNOWN = "PULocationID IS NOT NULL AND PULocationID NOT IN (264, 265)"
TOP = (
    f"top AS (SELECT PULocationID, count(*) AS trips FROM c WHERE {KNOWN} GROUP BY PULocationID"
    " ORDER BY trips DESC, PULocationID LIMIT 10)"
)
SUMS = f"count(*) AS trips, {total('total_amount')} AS total_revenue, {mean('total_amount')} AS avg_total"
ORACLES["top_zones_trips"] = query("SELECT * FROM top", *CLEAN_STEPS, TOP)
ORACLES["top_zones_revenue"] = query(
    f"SELECT PULocationID, {SUMS} FROM c WHERE {KNOWN} GROUP BY PULocationID"
    " ORDER BY total_revenue DESC, PULocationID LIMIT 10",
    *CLEAN_STEPS,
)
ORACLES["zone_hour_demand"] = query(
    f"SELECT PULocationID, {HOUR} AS pickup_hour, count(*) AS trips FROM c"
    " WHERE PULocationID IN (SELECT PULocationID FROM top) GROUP BY ALL",
    *CLEAN_STEPS,
    TOP,
)
ORACLES["zone_payment_revenue"] = query(
    f"SELECT PULocationID, {PAYMENT_LABEL} AS payment_label, {SUMS} FROM c"
    " WHERE PULocationID IN (SELECT PULocationID FROM top) GROUP BY ALL",
    *CLEAN_STEPS,
    TOP,
)
ORACLES["band_matrix"] = query(
    "SELECT CASE WHEN trip_distance <= 1 THEN '[0,1]' WHEN trip_distance <= 3 THEN '(1,3]' WHEN trip_distance <= 5"
    " THEN '(3,5]' WHEN trip_distance <= 10 THEN '(5,10]' WHEN trip_distance <= 20 THEN '(10,20]' ELSE '(20,Inf]' END"
    " AS distance_band, CASE WHEN secs <= 300 THEN '[0,5]' WHEN secs <= 600 THEN '(5,10]' WHEN secs <= 1200 THEN"
    " '(10,20]' WHEN secs <= 2400 THEN '(20,40]' WHEN secs <= 3600 THEN '(40,60]' ELSE '(60,Inf]' END"
    f" AS duration_band, count(*) AS trips, {mean('total_amount')} AS avg_total_amount FROM c"
    " WHERE trip_distance >= 0 AND secs >= 0 AND total_amount >= 0 GROUP BY ALL",
    *CLEAN_STEPS,
)
ORACLES["policy_pre_post"] = query(
    f"SELECT CASE WHEN tpep_pickup_datetime >= {POLICY} THEN 'Post Jan 5' ELSE 'Pre Jan 5' END AS cbd_period,"
    f" count(*) AS trips, {mean('total_amount')} AS avg_total_amount, {total('cbd_congestion_fee')} AS total_cbd_fee,"
    f" {mean('cbd_congestion_fee')} AS avg_cbd_fee,"
    f" {cnt('cbd_congestion_fee > 0')}::DOUBLE / count(cbd_congestion_fee)::DOUBLE AS cbd_positive_share"
    " FROM c GROUP BY ALL",
    *CLEAN_STEPS,
)

# --- zones
REVENUE = (
    f"rev AS (SELECT PULocationID, count(*) AS trips, {total('total_amount')} AS total_revenue,"
    f" {mean('total_amount')} AS avg_revenue FROM c WHERE {KNOWN} AND total_amount >= 0 GROUP BY PULocationID)"
)
ORACLES["zone_revenue"] = query("SELECT * FROM rev", *CLEAN_STEPS, REVENUE)
ORACLES["zone_revenue_groups"] = query(
    "SELECT LocationID, Borough, Zone, service_zone, trips, total_revenue, avg_revenue,"
    " CASE WHEN total_revenue IS NULL THEN 'No data' WHEN total_revenue < 10000 THEN '0–10k'"
    " WHEN total_revenue < 50000 THEN '10k–50k' WHEN total_revenue < 100000 THEN '50k–100k'"
    " WHEN total_revenue < 500000 THEN '100k–500k' ELSE '500k+' END AS revenue_group"
    " FROM zones LEFT JOIN rev ON PULocationID = LocationID",
    *CLEAN_STEPS,
    REVENUE,
    *ZONES,
)
AGG = "agg AS (" + " UNION ALL ".join(
    f"SELECT {zone} AS LocationID, count(*) AS trips, {total('total_amount')} AS revenue, {mean('fare_amount')} AS"
    f" avg_fare, {mean('tip_amount')} AS avg_tip, '{kind}' AS zone_type FROM c GROUP BY {zone}"
    for zone, kind in (("PULocationID", "pickup"), ("DOLocationID", "dropoff"))
) + ")"
for name in ("zone_agg", "write_zone_agg"):
    ORACLES[name] = query("SELECT * FROM agg", *CLEAN_STEPS, AGG)
for name, kind, shown in (
    ("zone_view", "pickup", "ln(1 + revenue)"),
    ("zone_view_trips", "dropoff", "trips::DOUBLE"),
):
    ORACLES[name] = query(
        "SELECT LocationID, Borough, Zone, service_zone, trips, revenue, avg_fare, avg_tip,"
        f" round({shown}, 9) AS display_value FROM zones LEFT JOIN (SELECT * FROM agg WHERE zone_type = '{kind}')"
        " USING (LocationID)",
        *CLEAN_STEPS,
        AGG,
        *ZONES,
    )
for name, kind in (("zone_kpis", "pickup"), ("zone_kpis_dropoff", "dropoff")):
    ORACLES[name] = query(
        "SELECT sum(trips)::BIGINT AS trips, (sum(revenue::DECIMAL(28,6)))::DOUBLE AS revenue,"
        " (sum((avg_fare * trips)::DECIMAL(28,6)))::DOUBLE / sum(trips)::DOUBLE AS avg_fare"
        f" FROM agg WHERE zone_type = '{kind}'",
        *CLEAN_STEPS,
        AGG,
    )

# --- polygons by their closed forms, and a trend by a weighted line over the trips themselves
ORACLES["zone_polygons"] = query(
    "SELECT LocationID, 2 AS n_parts, 1 AS n_holes, 12 AS n_points, 106.0::DOUBLE AS area,"
    " round((100.0::DOUBLE * (LocationID + 5) - 6.0::DOUBLE * (LocationID + 3) + 12.0::DOUBLE * (LocationID + 22)) / 106.0::DOUBLE, 6) AS centroid_x,"
    " round((500.0::DOUBLE - 21.0::DOUBLE + 16.0::DOUBLE) / 106.0::DOUBLE, 6) AS centroid_y,"
    " LocationID::DOUBLE AS min_x, 0.0::DOUBLE AS min_y, (LocationID + 26)::DOUBLE AS max_x, 10.0::DOUBLE AS max_y FROM zones",
    *ZONES,
)
ORACLES["local_trend"] = query(
    "SELECT bin, n, mid AS \"at\", round(my + coalesce(slope, 0) * (mid - mx), 6) AS fitted FROM (SELECT b.bin, any_value(b.n) AS n, b.mid,"
    " sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my,"
    " (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / nullif(sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w), 0) AS slope"
    " FROM (SELECT b.*, x, y, power(1 - power(least(abs(p.mid - b.mid) / 4.0::DOUBLE, 1), 3), 3) AS w FROM bins b JOIN points p ON abs(p.mid - b.mid) < 4) b"
    " GROUP BY b.bin, b.mid)",
    *CLEAN_STEPS,
    "points AS (SELECT floor(trip_distance / 0.5::DOUBLE)::BIGINT AS bin, (floor(trip_distance / 0.5::DOUBLE) + 0.5::DOUBLE) * 0.5::DOUBLE AS mid,"
    " trip_distance AS x, total_amount::DOUBLE AS y FROM c WHERE trip_distance IS NOT NULL AND total_amount IS NOT NULL)",
    "bins AS (SELECT bin, mid, count(*) AS n FROM points GROUP BY bin, mid)",
)
