"""Column names, types and default parameters of a trip-billing table."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "trip_id"
VENDOR = "VendorID"
PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
PASSENGERS = "passenger_count"
DISTANCE = "trip_distance"
RATE = "RatecodeID"
FLAG = "store_and_fwd_flag"
PU = "PULocationID"
DO = "DOLocationID"
PAYMENT = "payment_type"
FARE = "fare_amount"
EXTRA = "extra"
MTA = "mta_tax"
TIP = "tip_amount"
TOLLS = "tolls_amount"
IMPROVEMENT = "improvement_surcharge"
TOTAL = "total_amount"
CONGESTION = "congestion_surcharge"
AIRPORT = "Airport_fee"
CBD = "cbd_congestion_fee"
MONTH = "source_month"

MONEY_TYPE = T.DecimalType(12, 2)

# The components that should add up to the total.
PARTS = (FARE, EXTRA, MTA, IMPROVEMENT, TOLLS, CONGESTION, AIRPORT, CBD, TIP)
MONEY = PARTS + (TOTAL,)

COLUMNS = {
    ID: T.LongType(),
    VENDOR: T.IntegerType(),
    PICKUP: T.TimestampNTZType(),
    DROPOFF: T.TimestampNTZType(),
    PASSENGERS: T.LongType(),
    DISTANCE: T.DoubleType(),
    RATE: T.IntegerType(),
    FLAG: T.StringType(),
    PU: T.IntegerType(),
    DO: T.IntegerType(),
    PAYMENT: T.IntegerType(),
    FARE: MONEY_TYPE,
    EXTRA: MONEY_TYPE,
    MTA: MONEY_TYPE,
    TIP: MONEY_TYPE,
    TOLLS: MONEY_TYPE,
    IMPROVEMENT: MONEY_TYPE,
    TOTAL: MONEY_TYPE,
    CONGESTION: MONEY_TYPE,
    AIRPORT: MONEY_TYPE,
    CBD: MONEY_TYPE,
    MONTH: T.StringType(),
}

# Fields that go missing together.
NULL_BLOCK = (RATE, FLAG, CONGESTION)

# Two trips with equal values here are near copies.
SIMPLE_KEYS = (PICKUP, DROPOFF, PU, DO)
STRICT_KEYS = SIMPLE_KEYS + (DISTANCE, VENDOR, RATE, PAYMENT)

# Time window and policy date.
WINDOW_START = "2025-01-01 00:00:00"
WINDOW_END = "2025-03-31 23:59:59"
AFTER_WINDOW = "2025-04-01 00:00:00"
POLICY_DATE = "2025-01-05 00:00:00"

# Valid codes.
VALID_CODES = {
    RATE: (1, 2, 3, 4, 5, 6, 99),
    FLAG: ("Y", "N"),
    PAYMENT: (0, 1, 2, 3, 4, 5, 6),
}
UNKNOWN_ZONES = (264, 265)
AIRPORT_PICKUP_ZONES = (132, 138)
AIRPORT_FEES = ("1.25", "1.75")
CLEANING_AIRPORT_ZONES = (132, 138, 1)
BAD_CLOCK_VENDORS = (6, 7)

# Zones that imply a rate code.
JFK_ZONES = (1, 132, 138)
SUBURBAN_ZONES = (
    4, 7, 14, 29, 30, 44, 52, 55, 56, 57, 60, 61, 62, 63, 64, 65, 71, 72, 83, 84,
    85, 86, 91, 92, 93, 94, 95, 96, 97, 98, 99, 110, 117, 118, 119, 133, 134, 135,
    136, 167, 168, 169, 174, 175, 176, 177, 178, 179, 187, 188, 189, 190, 191, 192,
    193, 200, 201, 203, 204, 205, 206, 207, 208, 212, 213, 214, 215, 216, 217, 218,
    219, 220, 221, 222, 223, 225, 226, 227, 228, 247, 248, 250, 251, 252, 253, 254,
    257, 258, 259, 260, 264, 265,
)

# Pickup zones with the most unexplained gaps.
GAP_ZONES = (
    232, 224, 4, 54, 45, 209, 66, 87, 33, 40, 128, 50, 88, 158, 148, 79, 255, 144,
    256, 112,
)

# Zones inside the congestion area.
CONGESTION_ZONES = (
    4, 12, 13, 24, 41, 42, 43, 45, 48, 50, 68, 74, 75, 79, 87, 88, 90, 100, 103, 104,
    105, 107, 113, 114, 116, 120, 125, 127, 128, 137, 140, 141, 142, 143, 144, 148,
    151, 152, 153, 158, 161, 162, 163, 164, 166, 170, 186, 194, 202, 209, 211, 224,
    229, 230, 231, 232, 233, 234, 236, 237, 238, 239, 243, 244, 246, 249, 261, 262,
    263,
)
