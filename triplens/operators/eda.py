"""Aggregates behind the charts: demand, payments, revenue, policy effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions import labels as L
from triplens.functions.expressions import (
    both,
    exact,
    instant,
    is_in,
    mean,
    minutes,
    seconds,
    share_of_all,
    total,
)
from triplens.functions.stats import (
    percentiles,
    value_counts,
    weighted_mean,
    weighted_median,
)
from triplens.sources.shared import pin

# Upper edges of the bands; the last band is open.
DISTANCE_EDGES = (1, 3, 5, 10, 20)
DURATION_EDGES = (5, 10, 20, 40, 60)


def add_calendar(df: DataFrame, policy_date: str = S.POLICY_DATE) -> DataFrame:
    when = F.col(S.PICKUP)
    return df.withColumns(
        {
            "pickup_date": F.to_date(when),
            "pickup_month": F.date_trunc("month", when).cast("timestamp_ntz"),
            "pickup_month_label": F.date_format(when, "yyyy-MM"),
            "pickup_hour": F.hour(when),
            "pickup_weekday": F.date_format(when, "EEEE"),
            "duration_min": minutes(),
            "is_post_cbd": when >= instant(policy_date),
        }
    )


def add_labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "payment_label": L.label(S.PAYMENT, L.DASHBOARD_PAYMENT, L.MISSING),
            "rate_label": L.label(S.RATE, L.DASHBOARD_RATE, L.MISSING),
        }
    )


def _fraction(test: Column) -> Column:
    """Share (0 to 1) of true among the rows where the test is decided."""
    return F.try_divide(F.count_if(test).cast("double"), F.count(test).cast("double"))


def kpi_summary(df: DataFrame) -> DataFrame:
    """Twelve key figures in one row.

    All but the median add up, so everything is first summed per total amount and then merged.
    """
    card, cash = F.col(S.PAYMENT) == 1, F.col(S.PAYMENT) == 2
    fee = F.col(S.CBD) > 0
    sums = {
        "fare": exact(S.FARE),
        "distance": exact(S.DISTANCE),
        "seconds": seconds(),
        "tip": exact(S.TIP),
        "card": card.cast("int"),
        "cash": cash.cast("int"),
        "cbd": fee.cast("int"),
    }
    counts = df.groupBy(S.TOTAL).agg(
        F.count("*").alias("n"),
        F.count_if(is_in(S.PU, S.AIRPORT_PICKUP_ZONES)).alias("airport"),
        *[F.sum(c).alias(f"s_{k}") for k, c in sums.items()],
        *[F.count(c).alias(f"n_{k}") for k, c in sums.items()],
    )
    n, amount = F.col("n"), F.col(S.TOTAL)

    def average(name: str) -> Column:
        return F.try_divide(F.sum(f"s_{name}").cast("double"), F.sum(f"n_{name}").cast("double"))

    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_trips"),
        F.sum(amount * n).cast("double").alias("total_revenue"),
        weighted_mean(amount, n).alias("avg_total_amount"),
        weighted_median(amount, n).alias("median_total_amount"),
        average("fare").alias("avg_fare_amount"),
        average("distance").alias("avg_trip_distance"),
        (average("seconds") / F.lit(60.0)).alias("avg_duration_min"),
        average("tip").alias("avg_tip_amount"),
        average("card").alias("credit_card_share"),
        average("cash").alias("cash_share"),
        F.try_divide(F.sum("airport").cast("double"), F.sum(n).cast("double")).alias(
            "airport_pickup_share"
        ),
        average("cbd").alias("cbd_positive_share"),
    )


def trip_counts(df: DataFrame, *by: str) -> DataFrame:
    """Trips per combination of calendar columns, labels or zones."""
    return df.groupBy(*by).agg(F.count("*").alias("trips"))


def trips_by_date(df: DataFrame) -> DataFrame:
    return trip_counts(add_calendar(df), "pickup_date").orderBy("pickup_date")


def trips_by_month(df: DataFrame) -> DataFrame:
    return trip_counts(add_calendar(df), "pickup_month_label").orderBy("pickup_month_label")


def trips_by_hour(df: DataFrame) -> DataFrame:
    return trip_counts(add_calendar(df), "pickup_hour").orderBy("pickup_hour")


def weekday_demand(df: DataFrame) -> DataFrame:
    return trip_counts(add_calendar(df), "pickup_weekday")


def demand_matrix(df: DataFrame, a: str, b: str = "pickup_hour") -> DataFrame:
    return trip_counts(add_calendar(df), a, b)


def histogram(df: DataFrame, value: Column, bins: int = 60, q: float = 0.99, unit: float = 1.0) -> DataFrame:
    """(bin, low, high, n) of the values between the smallest from zero on and an exact quantile.

    Equal values are counted once over the table; limits and bins both come from those counts.
    Values are binned as they are; ``low`` and ``high`` are shown divided by ``unit``.
    """
    counts = pin(
        value_counts(df, [], {"value": value})
        .where(F.col("value") >= 0)
        .select(F.col("value").cast("double").alias("value"), "n")
    )
    limits = percentiles(counts, [], [0.0, q]).select("q").scalar()
    low, cap = limits[0], limits[1]
    width = (cap - low) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col("value") - low, width))
    slot = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    shown = counts.where(F.col("value") <= cap)
    return (
        shown.groupBy(slot.alias("bin"))
        .agg(F.sum("n").alias("n"))
        .withColumns(
            {
                "low": (low + F.col("bin") * width) / F.lit(unit),
                "high": (low + (F.col("bin") + 1) * width) / F.lit(unit),
            }
        )
        .orderBy("bin")
    )


def passenger_freq(df: DataFrame) -> DataFrame:
    return trip_counts(df.where(F.col(S.PASSENGERS).isNotNull()), S.PASSENGERS).orderBy(S.PASSENGERS)


def label_freq(df: DataFrame, label: str) -> DataFrame:
    counts = trip_counts(add_labels(df), label)
    whole = share_of_all("trips") / F.lit(100.0)
    return counts.withColumn("share", whole).orderBy(F.desc("trips"), label)


def payment_behavior(df: DataFrame) -> DataFrame:
    """Trips, mean and median tip and total per payment label."""
    counts = value_counts(
        add_labels(df), ["payment_label"], {"tip": F.col(S.TIP), "total": F.col(S.TOTAL)}
    )
    n = F.col("n")
    tip = F.when(F.col("variable") == "tip", F.col("value"))
    amount = F.when(F.col("variable") == "total", F.col("value"))
    return (
        counts.groupBy("payment_label")
        .agg(
            F.sum(F.when(F.col("variable") == "tip", n)).alias("trips"),
            weighted_mean(tip, n).alias("avg_tip"),
            weighted_median(tip, n).alias("median_tip"),
            weighted_mean(amount, n).alias("avg_total"),
            weighted_median(amount, n).alias("median_total"),
        )
        .orderBy(F.desc("trips"), "payment_label")
    )


def sample_points(
    df: DataFrame,
    n: int = 100_000,
    seed: int = 123,
    cols: Sequence[str] = (S.DISTANCE, S.TOTAL),
    key: str = S.ID,
) -> DataFrame:
    """A repeatable random sample of exactly n rows (or all, if fewer).

    Rows are ranked by a hash of their id. Counting rows per hash prefix (at most 2**20
    prefixes) tells which prefixes are in, which are out, and how many rows the one on the
    border still gives. So nothing is sorted but the rows inside a prefix, and n may be large.
    """
    kept = df
    for c in cols:
        kept = kept.where(F.col(c) >= 0)
    ticket = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = kept.select(key, *cols, ticket.alias("ticket")).withColumn(
        "prefix", F.substring("ticket", 1, 5)
    )
    sizes = ranked.groupBy("prefix").agg(F.count("*").alias("rows_"))
    up_to = F.sum("rows_").over(Window.orderBy("prefix"))
    before = sizes.select("prefix", (up_to - F.col("rows_")).alias("before"))
    border = before.where(F.col("before") < n).agg(F.max(F.struct("prefix", "before"))).scalar()
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("ticket", key))
    chosen = ranked.where(F.col("prefix") <= border["prefix"]).withColumn("place", place)
    inside = (F.col("prefix") < border["prefix"]) | (F.col("place") <= n - border["before"])
    return chosen.where(inside).select(key, *cols)


def sample_in_range(
    df: DataFrame, n: int = 100_000, seed: int = 123, q: float = 0.99
) -> DataFrame:
    """The sample of (distance, total) among rows up to the exact quantile of both."""
    measures = {S.DISTANCE: F.col(S.DISTANCE), S.TOTAL: F.col(S.TOTAL)}
    counts = pin(value_counts(df, [], measures).where(F.col("value") >= 0))
    found = percentiles(counts, ["variable"], [q])
    caps = [F.max(F.when(F.col("variable") == c, F.col("q")[0])).alias(c) for c in measures]
    cap = found.agg(F.struct(*caps)).scalar()
    rows = df.where(both([F.col(c).cast("double") <= cap[c] for c in measures]))
    return sample_points(rows, n, seed)


def known_pickups(df: DataFrame, unknown: Sequence[int] = S.UNKNOWN_ZONES) -> DataFrame:
    return df.where(F.col(S.PU).isNotNull() & ~F.col(S.PU).isin(*unknown))


def top_zones_by_trips(df: DataFrame, n: int = 10) -> DataFrame:
    counts = trip_counts(known_pickups(df), S.PU)
    return counts.orderBy(F.desc("trips"), S.PU).limit(n)


def zone_money(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("trips"),
        total(S.TOTAL).alias("total_revenue"),
        mean(S.TOTAL).alias("avg_total"),
    )


def top_zones_by_revenue(df: DataFrame, n: int = 10) -> DataFrame:
    zones = zone_money(known_pickups(df), S.PU)
    return zones.orderBy(F.desc("total_revenue"), S.PU).limit(n)


def in_top_zones(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows picked up in the n busiest zones; n ids are all that is broadcast."""
    return df.join(F.broadcast(top_zones_by_trips(df, n).select(S.PU)), S.PU, "left_semi")


def zone_hour_demand(df: DataFrame, n: int = 10) -> DataFrame:
    return trip_counts(add_calendar(in_top_zones(df, n)), S.PU, "pickup_hour")


def zone_payment_revenue(df: DataFrame, n: int = 10) -> DataFrame:
    return zone_money(add_labels(in_top_zones(df, n)), S.PU, "payment_label")


def band(value: Column, edges: Sequence[int]) -> Column:
    """Band name of a value; upper edges belong to the band, and zero to the first one."""
    out, low = F, 0
    for edge in edges:
        name = f"[{low},{edge}]" if low == 0 else f"({low},{edge}]"
        out, low = out.when(value <= edge, name), edge
    return out.when(value.isNotNull(), f"({low},Inf]")


def band_matrix(df: DataFrame) -> DataFrame:
    """Trips and mean total per distance and duration band."""
    distance, duration = F.col(S.DISTANCE), seconds()
    rows = df.where((distance >= 0) & (duration >= 0) & (F.col(S.TOTAL) >= 0))
    return rows.groupBy(
        band(distance, DISTANCE_EDGES).alias("distance_band"),
        band(duration / 60, DURATION_EDGES).alias("duration_band"),
    ).agg(F.count("*").alias("trips"), mean(S.TOTAL).alias("avg_total_amount"))


def policy_pre_post(df: DataFrame, policy_date: str = S.POLICY_DATE) -> DataFrame:
    """Fee and totals before and after the policy date."""
    when = F.col(S.PICKUP)
    # Names of the two periods.
    period = F.when(when >= instant(policy_date), "Post Jan 5").when(when.isNotNull(), "Pre Jan 5")
    return df.groupBy(period.alias("cbd_period")).agg(
        F.count("*").alias("trips"),
        mean(S.TOTAL).alias("avg_total_amount"),
        total(S.CBD).alias("total_cbd_fee"),
        mean(S.CBD).alias("avg_cbd_fee"),
        _fraction(F.col(S.CBD) > 0).alias("cbd_positive_share"),
    )
