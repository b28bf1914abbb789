"""A trip table and a zone dimension derived from the order tables.

The order tables have no trips. Each order becomes one trip, and some orders also become the
void copies that billing systems write, so that every check has something to find. Each order
row is read once; its copies come from exploding a short array.

The table is derived once per application and stored in the shared folder, as trip tables are:
queries then scan plain columns and push their filters down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplens import schema as S
from triplens.sources.readers import typed_trips
from triplens.sources.shared import new_path, shared_folder

START = "TIMESTAMP_NTZ '2024-12-30 00:00:00'"

# Attributes of a trip; k is the order key, c the customer key. Amounts are in cents.
BASE = {
    "VendorID": "CASE WHEN c%100=0 THEN 6 WHEN c%100=1 THEN 7 WHEN c%4=0 THEN 1 ELSE 2 END",
    "pu": f"{START} + INTERVAL '1' SECOND * ((k*7919)%8035200)",
    "dur_s": "CASE WHEN k%53=0 THEN 0 WHEN k%211=0 THEN -600 WHEN k%307=0 THEN 14400 ELSE 60+(k*131)%5400 END",
    "passenger_count": "CASE WHEN c%5=3 THEN NULL ELSE 1+k%6 END",
    "trip_distance": "CAST(CASE WHEN k%97=0 THEN 0 WHEN k%499=0 THEN 15000 ELSE 30+(k*37)%2500 END AS DOUBLE)/100",
    "RatecodeID": "CASE WHEN c%5=3 THEN NULL WHEN k%40=0 THEN 2 WHEN k%101=0 THEN 3 WHEN k%67=0 THEN 5 WHEN k%89=0 THEN 99 ELSE 1 END",
    "store_and_fwd_flag": "CASE WHEN c%5=3 THEN NULL WHEN k%200=0 THEN 'Y' ELSE 'N' END",
    "PULocationID": "CAST(CASE WHEN k%4=0 THEN 220+(k*3)%23 ELSE 1+(k*31)%265 END AS INT)",
    "DOLocationID": "CAST(CASE WHEN c%4=0 THEN 100+(c*7)%23 ELSE 1+(c*17)%265 END AS INT)",
    "payment_type": "CASE WHEN c%5=3 THEN 0 WHEN k%7=0 THEN 2 WHEN k%59=0 THEN 3 WHEN k%61=0 THEN 4 ELSE 1 END",
    "fare_c": "300+(k*53)%7000",
    "extra_c": "(k%4)*100",
    "mta_c": "CASE WHEN k%83=0 THEN 0 ELSE 50 END",
    "tip_c": "CASE WHEN k%7=0 THEN 0 ELSE (k*11)%1500 END",
    "tolls_c": "CASE WHEN k%20=0 THEN 694 ELSE 0 END",
    "impr_c": "CASE WHEN k%701=0 THEN 30 ELSE 100 END",
    "cong_c": "CASE WHEN c%5=3 THEN NULL WHEN k%3=0 THEN 0 ELSE 250 END",
    "air_c": "CASE WHEN c%5=3 THEN NULL WHEN k%353=0 THEN 500 WHEN (1+(k*31)%265) IN (132,138) OR k%151=0 THEN 175 ELSE 0 END",
    "cbd_c": "CASE WHEN k%4=0 THEN 75 ELSE 0 END",
    "gap_c": "CASE WHEN k%13=0 THEN 250 WHEN k%29=0 THEN -75 WHEN k%997=0 THEN 6000 ELSE 0 END",
    "source_month": "CASE WHEN k%3=0 THEN '2025-01' WHEN k%3=1 THEN '2025-02' ELSE '2025-03' END",
}

# Which copies an order has, and the sign of each amount on a copy. Copies 1 and 2 are voids and repeats beside the
# trip; 3 is a void at another time, which belongs to no pair; 4 is a repeat of another length.
COPIES = (
    "CASE WHEN k%310=0 THEN array(0,1,2) WHEN k%31=0 THEN array(0,1) WHEN k%239=0 THEN array(0,3)"
    " WHEN k%173=0 THEN array(0,4) ELSE array(0) END"
)
SIGNS = {
    "sg": "CASE WHEN j=3 THEN -1 WHEN j<>1 OR k%5=0 THEN 1 WHEN k%17=0 THEN 0 ELSE -1 END",
    "sgm": "CASE WHEN j=3 THEN -1 WHEN j<>1 OR k%11=0 OR k%5=0 THEN 1 WHEN k%17=0 THEN 0 ELSE -1 END",
    "sgt": "CASE WHEN j=3 THEN -1 WHEN j<>1 THEN 1 WHEN k%3=0 THEN 0 ELSE -1 END",
    "sgs": "CASE WHEN j=3 THEN -1 WHEN j<>1 THEN 1 WHEN k%2=0 THEN 0 ELSE -1 END",
}
LATER = "INTERVAL '1' SECOND * IF(j=3, 1111, 0)"
AMOUNTS = {
    S.FARE: "fare_c*sg",
    S.EXTRA: "extra_c*sg",
    S.MTA: "mta_c*sgm",
    S.TIP: "tip_c*sgt",
    S.TOLLS: "tolls_c*sg",
    S.IMPROVEMENT: "impr_c*sg",
    S.CONGESTION: "cong_c*sg",
    S.AIRPORT: "air_c*sg",
    S.CBD: "cbd_c*sgs",
}


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derive_trips(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    keys = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    base = spread(keys).select("k", *[F.expr(e).alias(n) for n, e in BASE.items()])
    copies = base.select("*", F.explode(F.expr(COPIES)).alias("j"))
    signed = copies.select("*", *[F.expr(e).alias(n) for n, e in SIGNS.items()])
    cents = " + ".join(f"coalesce({e}, 0)" for e in AMOUNTS.values()) + " + gap_c*sg"
    amounts = {**AMOUNTS, S.TOTAL: cents}
    # One function makes money of all cents: ten decimal products side by side took 1.7 times the CPU time (cause not established).
    whole = ", ".join(f"CAST({e} AS BIGINT)" for e in amounts.values())
    held = signed.select("*", F.expr(f"transform(array({whole}), c -> CAST(c AS DECIMAL(10,0)) * 0.01)").alias("_money"))
    return typed_trips(
        held.select(
            F.expr("k*10+j").alias(S.ID),
            F.expr(f"pu + {LATER}").alias(S.PICKUP),
            F.expr(f"pu + {LATER} + INTERVAL '1' SECOND * dur_s").alias(S.DROPOFF),
            *[F.get("_money", i).alias(n) for i, n in enumerate(amounts)],
            S.VENDOR, S.PASSENGERS, F.expr(f"{S.DISTANCE} + IF(j=4, 1.5D, 0D)").alias(S.DISTANCE), S.RATE, S.FLAG, S.PU, S.DO, S.PAYMENT, S.MONTH,
        )
    )


_stored: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def stored(
    spark: SparkSession,
    name: str,
    folder: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None],
) -> DataFrame:
    """The named table derived from a folder: written on first use, read from then on."""
    if shared_folder(spark) is None:
        return build()
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _stored:
        path = new_path(spark, name)
        write(build(), path)
        _stored[key] = path, spark.read.parquet(path).schema
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    return stored(
        spark,
        "trips",
        folder,
        lambda: derive_trips(spark, folder),
        lambda df, path: df.write.parquet(path),
    )


def zones(spark: SparkSession, folder: str, trip_table: DataFrame) -> DataFrame:
    """Every zone that occurs in the trips, named after a nation, its borough after a region."""
    ids = (
        trip_table.select(F.inline(F.array(*[F.struct(F.col(c).alias("LocationID")) for c in (S.PU, S.DO)])))
        .where(F.col("LocationID").isNotNull())
        .distinct()
    )
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    region = spark.read.parquet(f"{folder}/region.parquet")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return ids.join(names, F.col("LocationID") % 25 == names.n_nationkey).select(
        "LocationID",
        F.col("r_name").alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.concat("r_name", F.lit(" zone")).alias("service_zone"),
    )
