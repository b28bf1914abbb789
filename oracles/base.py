"""SQL building blocks of the oracles: the derived trip table and a few formulas.

The oracles are written on their own, row by row where the library counts first, so that the
two can check each other.
"""

from __future__ import annotations

TRIPS = """
WITH src AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
base AS (SELECT k, k*10 AS trip_id,
 CAST(CASE WHEN c%100=0 THEN 6 WHEN c%100=1 THEN 7 WHEN c%4=0 THEN 1 ELSE 2 END AS INT) AS VendorID,
 TIMESTAMP '2024-12-30 00:00:00' + INTERVAL '1' SECOND * ((k*7919)%8035200) AS pu,
 CASE WHEN k%53=0 THEN 0 WHEN k%211=0 THEN -600 WHEN k%307=0 THEN 14400 ELSE 60+(k*131)%5400 END AS dur_s,
 CASE WHEN c%5=3 THEN NULL ELSE 1+k%6 END AS passenger_count,
 CAST(CASE WHEN k%97=0 THEN 0 WHEN k%499=0 THEN 15000 ELSE 30+(k*37)%2500 END AS DOUBLE)/100 AS trip_distance,
 CASE WHEN c%5=3 THEN NULL WHEN k%40=0 THEN 2 WHEN k%101=0 THEN 3 WHEN k%67=0 THEN 5 WHEN k%89=0 THEN 99 ELSE 1 END AS RatecodeID,
 CASE WHEN c%5=3 THEN NULL WHEN k%200=0 THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
 CAST(CASE WHEN k%4=0 THEN 220+(k*3)%23 ELSE 1+(k*31)%265 END AS INT) AS PULocationID,
 CAST(CASE WHEN c%4=0 THEN 100+(c*7)%23 ELSE 1+(c*17)%265 END AS INT) AS DOLocationID,
 CASE WHEN c%5=3 THEN 0 WHEN k%7=0 THEN 2 WHEN k%59=0 THEN 3 WHEN k%61=0 THEN 4 ELSE 1 END AS payment_type,
 CAST(300+(k*53)%7000 AS BIGINT) AS fare_c, CAST((k%4)*100 AS BIGINT) AS extra_c,
 CASE WHEN k%83=0 THEN 0 ELSE 50 END AS mta_c, CASE WHEN k%7=0 THEN 0 ELSE (k*11)%1500 END AS tip_c,
 CASE WHEN k%20=0 THEN 694 ELSE 0 END AS tolls_c, CASE WHEN k%701=0 THEN 30 ELSE 100 END AS impr_c,
 CASE WHEN c%5=3 THEN NULL WHEN k%3=0 THEN 0 ELSE 250 END AS cong_c,
 CASE WHEN c%5=3 THEN NULL WHEN k%353=0 THEN 500 WHEN (1+(k*31)%265) IN (132,138) OR k%151=0 THEN 175 ELSE 0 END AS air_c,
 CASE WHEN k%4=0 THEN 75 ELSE 0 END AS cbd_c,
 CASE WHEN k%13=0 THEN 250 WHEN k%29=0 THEN -75 WHEN k%997=0 THEN 6000 ELSE 0 END AS gap_c
 FROM src),
copies AS (
 SELECT *, 0 AS j, 1 AS sg, 1 AS sgm, 1 AS sgt, 1 AS sgs FROM base
 UNION ALL SELECT *, 1, CASE WHEN k%5=0 THEN 1 WHEN k%17=0 THEN 0 ELSE -1 END, CASE WHEN k%11=0 OR k%5=0 THEN 1 WHEN k%17=0 THEN 0 ELSE -1 END, CASE WHEN k%3=0 THEN 0 ELSE -1 END, CASE WHEN k%2=0 THEN 0 ELSE -1 END FROM base WHERE k%31=0
 UNION ALL SELECT *, 2, 1, 1, 1, 1 FROM base WHERE k%310=0
 UNION ALL SELECT * REPLACE (pu + INTERVAL '1' SECOND * 1111 AS pu), 3, -1, -1, -1, -1 FROM base WHERE k%31<>0 AND k%239=0
 UNION ALL SELECT * REPLACE (trip_distance + 1.5 AS trip_distance), 4, 1, 1, 1, 1 FROM base WHERE k%31<>0 AND k%239<>0 AND k%173=0),
raw AS (
 SELECT trip_id+j AS trip_id, VendorID, pu AS tpep_pickup_datetime, pu + INTERVAL '1' SECOND * dur_s AS tpep_dropoff_datetime,
 passenger_count, trip_distance, RatecodeID, store_and_fwd_flag, PULocationID, DOLocationID, payment_type,
 CAST(fare_c*sg AS DOUBLE)/100 AS fare_amount, CAST(extra_c*sg AS DOUBLE)/100 AS extra, CAST(mta_c*sgm AS DOUBLE)/100 AS mta_tax,
 CAST(tip_c*sgt AS DOUBLE)/100 AS tip_amount, CAST(tolls_c*sg AS DOUBLE)/100 AS tolls_amount, CAST(impr_c*sg AS DOUBLE)/100 AS improvement_surcharge,
 CAST((fare_c*sg+extra_c*sg+mta_c*sgm+tip_c*sgt+tolls_c*sg+impr_c*sg+coalesce(cong_c,0)*sg+coalesce(air_c,0)*sg+cbd_c*sgs+gap_c*sg) AS DOUBLE)/100 AS total_amount,
 CAST(cong_c*sg AS DOUBLE)/100 AS congestion_surcharge, CAST(air_c*sg AS DOUBLE)/100 AS Airport_fee, CAST(cbd_c*sgs AS DOUBLE)/100 AS cbd_congestion_fee,
 CASE WHEN k%3=0 THEN '2025-01' WHEN k%3=1 THEN '2025-02' ELSE '2025-03' END AS source_month
 FROM copies),
t AS (
 SELECT * REPLACE (
  CAST(fare_amount AS DECIMAL(12,2)) AS fare_amount, CAST(extra AS DECIMAL(12,2)) AS extra,
  CAST(mta_tax AS DECIMAL(12,2)) AS mta_tax, CAST(tip_amount AS DECIMAL(12,2)) AS tip_amount,
  CAST(tolls_amount AS DECIMAL(12,2)) AS tolls_amount,
  CAST(improvement_surcharge AS DECIMAL(12,2)) AS improvement_surcharge,
  CAST(total_amount AS DECIMAL(12,2)) AS total_amount,
  CAST(congestion_surcharge AS DECIMAL(12,2)) AS congestion_surcharge,
  CAST(Airport_fee AS DECIMAL(12,2)) AS Airport_fee,
  CAST(cbd_congestion_fee AS DECIMAL(12,2)) AS cbd_congestion_fee),
 (epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 1000000.0::DOUBLE AS secs,
 (epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 1000000.0::DOUBLE / 60.0::DOUBLE AS mins
 FROM raw)
"""

MONEY = (
    "fare_amount", "extra", "mta_tax", "improvement_surcharge", "tolls_amount",
    "congestion_surcharge", "Airport_fee", "cbd_congestion_fee", "tip_amount", "total_amount",
)
PARTS = MONEY[:-1]
COLUMNS = (
    "trip_id", "VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count",
    "trip_distance", "RatecodeID", "store_and_fwd_flag", "PULocationID", "DOLocationID",
    "payment_type", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
    "improvement_surcharge", "total_amount", "congestion_surcharge", "Airport_fee",
    "cbd_congestion_fee", "source_month",
)


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def pct(part: str, whole: str) -> str:
    return f"(100.0::DOUBLE * ({part}) / nullif(({whole})::DOUBLE, 0))"


def mean(x: str, cond: str = "TRUE") -> str:
    return (
        f"((sum(({x})::DECIMAL(18,6)) FILTER (WHERE {cond}))::DOUBLE"
        f" / nullif(count({x}) FILTER (WHERE {cond}), 0)::DOUBLE)"
    )


def total(x: str, cond: str = "TRUE") -> str:
    return f"(sum({x}) FILTER (WHERE {cond}))::DOUBLE"


def med(x: str, cond: str = "TRUE", q: float = 0.5) -> str:
    return f"(quantile_cont(({x})::DOUBLE, {q}) FILTER (WHERE {cond}))"


def whole_pct(n: str, by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"(100.0::DOUBLE * {n} / nullif((sum({n}) OVER ({over}))::DOUBLE, 0))"


def case(col: str, names: dict, default: str) -> str:
    whens = " ".join(f"WHEN {v} THEN '{n}'" for v, n in names.items())
    return f"CASE {col} {whens} ELSE '{default}' END"


def stack(selects: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {s} FROM {source}" for s in selects)


def rules(conditions: dict[str, str], name: str = "rule", source: str = "t") -> str:
    return stack(
        [
            f"'{r}' AS {name}, {cnt(c)} AS n, {pct(cnt(c), 'count(*)')} AS pct"
            for r, c in conditions.items()
        ],
        source,
    )


def columns(doubles: bool = True) -> str:
    """All trip columns, money as double."""
    return ", ".join(f"{c}::DOUBLE AS {c}" if c in MONEY and doubles else c for c in COLUMNS)


def with_tables(*ctes: str) -> str:
    return ",\n".join([TRIPS.rstrip(), *ctes]) + "\n"


def query(select: str, *ctes: str) -> str:
    return with_tables(*ctes) + select


def adjacent(name: str, source: str, col: str) -> str:
    """Rows equal to a neighbour on col, as a table."""
    return f"""{name} AS (SELECT * EXCLUDE (before_, after_) FROM (
 SELECT *, lag({col}) OVER (ORDER BY trip_id) AS before_, lead({col}) OVER (ORDER BY trip_id) AS after_
 FROM {source}) WHERE {col} = before_ OR {col} = after_)"""


REFUNDS = (
    adjacent("r1", "t", "tpep_pickup_datetime"),
    adjacent("r2", "r1", "tpep_dropoff_datetime"),
    adjacent("refunds", "r2", "PULocationID"),
)
RAW_DISPUTES = (
    "d0 AS (SELECT * FROM t WHERE payment_type = 4)",
    adjacent("disputes", "d0", "tpep_pickup_datetime"),
)
FLAGGED = (
    *REFUNDS,
    *RAW_DISPUTES,
    "f AS (SELECT *, "
    + " OR ".join(f"{c} < 0" for c in MONEY)
    + " AS any_negative, trip_id IN (SELECT trip_id FROM refunds UNION SELECT trip_id FROM disputes)"
    " AS is_refund_pair FROM t)",
)

START = "TIMESTAMP '2025-01-01 00:00:00'"
END = "TIMESTAMP '2025-03-31 23:59:59'"
AFTER = "TIMESTAMP '2025-04-01 00:00:00'"
POLICY = "TIMESTAMP '2025-01-05 00:00:00'"
ODD_DURATION = "(secs = 0 OR (VendorID IN (6, 7) AND secs < 0))"

# Step by step, each table from the one before.
CLEAN_STEPS = (
    *REFUNDS,
    "s1 AS (SELECT * FROM t WHERE trip_id NOT IN (SELECT trip_id FROM refunds))",
    "s2d AS (SELECT * FROM s1 WHERE payment_type = 4)",
    adjacent("s2r", "s2d", "tpep_pickup_datetime"),
    "s2 AS (SELECT * FROM s1 WHERE trip_id NOT IN (SELECT trip_id FROM s2r))",
    f"s3 AS (SELECT * FROM s2 WHERE NOT (tpep_pickup_datetime < {START} OR tpep_pickup_datetime > {END}))",
    f"s4 AS (SELECT * FROM s3 WHERE NOT (tpep_dropoff_datetime < {START}))",
    f"s5 AS (SELECT *, {ODD_DURATION} AS duration_flag FROM s4)",
    "s6 AS (SELECT * FROM s5 WHERE NOT (trip_distance <= 0 OR trip_distance >= 100))",
    "s7 AS (SELECT * FROM s6 WHERE (secs / 3600 > 3) IS NOT TRUE)",
    "s8 AS (SELECT * FROM s7 WHERE (PULocationID > 263 OR DOLocationID > 263) IS NOT TRUE)",
    "s9 AS (SELECT * FROM s8 WHERE (fare_amount < 3 OR fare_amount > 500 OR (RatecodeID = 1 AND fare_amount < 4) OR fare_amount > total_amount) IS NOT TRUE)",
    "s10 AS (SELECT * FROM s9 WHERE fare_amount >= 3 AND fare_amount <= 250 AND NOT (RatecodeID = 1 AND fare_amount < 4) AND fare_amount <= total_amount AND trip_distance > 0 AND trip_distance <= 100)",
    "s11 AS (SELECT * REPLACE (CASE WHEN extra < 0 AND fare_amount >= 0 THEN 0 ELSE extra END AS extra) FROM s10)",
    "s12 AS (SELECT * FROM s11 WHERE NOT (total_amount < 5 OR total_amount > 500))",
    "s13 AS (SELECT * REPLACE (CASE WHEN PULocationID IN (132, 138, 1) THEN 1.75 ELSE 0 END AS Airport_fee) FROM s12)",
    "s14 AS (SELECT * REPLACE ("
    + ", ".join(f"coalesce({p}, 0)::DECIMAL(12,2) AS {p}" for p in PARTS)
    + ") FROM s13)",
    "c AS (SELECT * REPLACE (("
    + " + ".join(PARTS)
    + ")::DECIMAL(12,2) AS total_amount), mins AS duration_mins FROM s14)",
)

GAP = "(total_amount - (" + " + ".join(PARTS) + "))::DECIMAL(14,2)"
EXPECTED = (
    "(total_amount - (fare_amount + extra + CASE WHEN RatecodeID = 1 THEN 0.50 WHEN RatecodeID IS NOT NULL"
    " THEN 0.00 END + 1.00 + tolls_amount + congestion_surcharge + Airport_fee + cbd_congestion_fee"
    " + tip_amount))::DECIMAL(14,2)"
)
JFK = "(1, 132, 138)"
SUBURBAN = (
    "(4, 7, 14, 29, 30, 44, 52, 55, 56, 57, 60, 61, 62, 63, 64, 65, 71, 72, 83, 84, 85, 86, 91, 92, 93,"
    " 94, 95, 96, 97, 98, 99, 110, 117, 118, 119, 133, 134, 135, 136, 167, 168, 169, 174, 175, 176, 177,"
    " 178, 179, 187, 188, 189, 190, 191, 192, 193, 200, 201, 203, 204, 205, 206, 207, 208, 212, 213, 214,"
    " 215, 216, 217, 218, 219, 220, 221, 222, 223, 225, 226, 227, 228, 247, 248, 250, 251, 252, 253, 254,"
    " 257, 258, 259, 260, 264, 265)"
)
GAPS = (
    "filled AS (SELECT * REPLACE (coalesce(congestion_surcharge, 0)::DECIMAL(12,2) AS congestion_surcharge,"
    " coalesce(Airport_fee, 0)::DECIMAL(12,2) AS Airport_fee,"
    " coalesce(cbd_congestion_fee, 0)::DECIMAL(12,2) AS cbd_congestion_fee) FROM t)",
    f"g0 AS (SELECT *, {GAP} AS gap, {EXPECTED} AS expected_gap,"
    f" CASE WHEN PULocationID IN {JFK} OR DOLocationID IN {JFK} THEN 2"
    " WHEN PULocationID = 1 AND DOLocationID = 1 THEN 3"
    f" WHEN PULocationID IN {SUBURBAN} OR DOLocationID IN {SUBURBAN} THEN 4 ELSE 1 END AS implied_rate"
    " FROM filled)",
    "g AS (SELECT *, abs(gap) >= 0.01 AS has, RatecodeID IS NOT NULL AND RatecodeID <> implied_rate AS changed FROM g0)",
)

ZONES = (
    "ids AS (SELECT PULocationID AS LocationID FROM t UNION SELECT DOLocationID FROM t)",
    "zones AS (SELECT LocationID, r_name AS Borough, n_name AS Zone, r_name || ' zone' AS service_zone"
    " FROM ids JOIN nation ON n_nationkey = LocationID % 25 JOIN region ON r_regionkey = n_regionkey)",
)
