"""Revenue and trips per zone, joined to the zone dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import mean, total
from triplens.operators.eda import known_pickups

# Revenue bands, upper edge and name.
REVENUE_BANDS = ((10_000, "0–10k"), (50_000, "10k–50k"), (100_000, "50k–100k"), (500_000, "100k–500k"))
# Sums of zone figures, independent of row order.
SUM_TYPE = "decimal(28,6)"
TOP_BAND, NO_DATA = "500k+", "No data"


def zone_revenue(df: DataFrame) -> DataFrame:
    """Trips, revenue and mean total per known pickup zone, refunds left out."""
    rows = known_pickups(df).where(F.col(S.TOTAL) >= 0)
    return rows.groupBy(S.PU).agg(
        F.count("*").alias("trips"),
        total(S.TOTAL).alias("total_revenue"),
        mean(S.TOTAL).alias("avg_revenue"),
    )


def zone_revenue_groups(zones: DataFrame, revenue: DataFrame) -> DataFrame:
    """Every zone with its revenue band; zones without trips are kept."""
    joined = zones.join(
        revenue.withColumnRenamed(S.PU, "LocationID"), "LocationID", "left"
    )
    band = F.when(F.col("total_revenue").isNull(), NO_DATA)
    for edge, name in REVENUE_BANDS:
        band = band.when(F.col("total_revenue") < edge, name)
    return joined.withColumn("revenue_group", band.otherwise(TOP_BAND))


def zone_agg(df: DataFrame) -> DataFrame:
    """Pickup and dropoff aggregates, stacked. The trips are read once: each gives two narrow rows."""
    sides = [
        F.struct(F.lit(side).alias("zone_type"), F.col(zone).alias("LocationID"))
        for side, zone in (("pickup", S.PU), ("dropoff", S.DO))
    ]
    rows = df.select(F.inline(F.array(*sides)), S.TOTAL, S.FARE, S.TIP)
    return rows.groupBy("LocationID", "zone_type").agg(
        F.count("*").alias("trips"),
        total(S.TOTAL).alias("revenue"),
        mean(S.FARE).alias("avg_fare"),
        mean(S.TIP).alias("avg_tip"),
    )


def zone_view(
    zones: DataFrame, agg: DataFrame, zone_type: str = "pickup", metric: str = "revenue"
) -> DataFrame:
    """Every zone with its aggregate and the value that a map shows for the metric."""
    side = agg.where(F.col("zone_type") == zone_type).drop("zone_type")
    shown = F.log1p("revenue") if metric == "revenue" else F.col("trips").cast("double")
    return zones.join(side, "LocationID", "left").withColumn("display_value", shown)


def zone_kpis(agg: DataFrame, zone_type: str = "pickup") -> DataFrame:
    """Trips, revenue and trip-weighted mean fare of one side."""
    side = agg.where(F.col("zone_type") == zone_type)
    weighted = (F.col("avg_fare") * F.col("trips")).cast(SUM_TYPE)
    weight = F.when(F.col("avg_fare").isNotNull(), F.col("trips"))
    return side.agg(
        F.sum("trips").alias("trips"),
        F.sum(F.col("revenue").cast(SUM_TYPE)).cast("double").alias("revenue"),
        F.try_divide(F.sum(weighted).cast("double"), F.sum(weight).cast("double")).alias("avg_fare"),
    )
