"""Business-rule checks. Any number of predicates share one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import (
    in_long_form,
    instant,
    is_in,
    mean,
    minutes,
    money,
    seconds,
    share,
    share_of_all,
    total_gap,
)
from triplens.functions.stats import value_counts, weighted_count, weighted_mean, weighted_median

TOLERANCE = "0.01"


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n, pct of rows) for every predicate, from a single aggregation."""
    row = df.agg(
        F.count("*").alias("rows_"), *[F.count_if(p).alias(name) for name, p in rules.items()]
    )
    return in_long_form(
        row,
        *[
            {"rule": F.lit(r), "n": F.col(r), "pct": share(F.col(r), F.col("rows_"))}
            for r in rules
        ],
    )


def ts_window_counts(
    df: DataFrame, start: str = S.WINDOW_START, after: str = S.AFTER_WINDOW
) -> DataFrame:
    return rule_counts(
        df,
        {
            "pickup_before": F.col(S.PICKUP) < instant(start),
            "pickup_after": F.col(S.PICKUP) >= instant(after),
            "dropoff_before": F.col(S.DROPOFF) < instant(start),
            "dropoff_after": F.col(S.DROPOFF) >= instant(after),
        },
    )


def duration_counts(df: DataFrame) -> DataFrame:
    """Negative and zero durations, and what the zero ones still charge. One row."""
    zero = seconds() == 0
    fare = zero & (F.col(S.FARE) != 0)
    distance = zero & (F.col(S.DISTANCE) != 0)
    return df.agg(
        F.count_if(seconds() < 0).alias("negative"),
        F.count_if(zero).alias("zero"),
        F.count_if(fare).alias("zero_with_fare"),
        share(F.count_if(fare), F.count_if(zero & F.col(S.FARE).isNotNull())).alias(
            "zero_with_fare_pct"
        ),
        F.count_if(distance).alias("zero_with_distance"),
        share(F.count_if(distance), F.count_if(zero & F.col(S.DISTANCE).isNotNull())).alias(
            "zero_with_distance_pct"
        ),
        mean(S.FARE, fare).alias("mean_fare"),
        mean(S.DISTANCE, distance).alias("mean_distance"),
    )


def zero_duration_freq(df: DataFrame, col: str = S.PAYMENT) -> DataFrame:
    rows = df.where((seconds() == 0) & F.col(col).isNotNull())
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def mix_compare(df: DataFrame, col: str = S.PAYMENT, group: Column | None = None) -> DataFrame:
    """The mix of ``col`` among the rows of a group (zero durations) against all other rows."""
    inside = seconds() == 0 if group is None else group
    counts = df.groupBy(col).agg(
        F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out")
    )
    mixed = counts.where((F.col("n_in") > 0) | (F.col("n_out") > 0)).select(
        col, share_of_all("n_in").alias("zero_duration"), share_of_all("n_out").alias("rest")
    )
    return mixed.withColumn("difference", F.col("zero_duration") - F.col("rest")).orderBy(col)


def distance_duration_counts(df: DataFrame) -> DataFrame:
    distance = F.col(S.DISTANCE)
    return rule_counts(
        df,
        {
            "negative_distance": distance < 0,
            "zero_distance_with_duration": (distance == 0) & (seconds() > 0),
            "zero_duration_with_distance": (seconds() == 0) & (distance > 0),
        },
    )


def code_violations(df: DataFrame, valid: Mapping[str, Sequence] = S.VALID_CODES) -> DataFrame:
    """Per coded column: filled rows and rows outside the valid set, in one pass."""
    bad = {c: ~F.col(c).isin(*codes) for c, codes in valid.items()}
    row = df.agg(
        F.count("*").alias("rows_"),
        *[F.count(c).alias(f"filled_{c}") for c in valid],
        *[F.count_if(p).alias(f"bad_{c}") for c, p in bad.items()],
    )
    return in_long_form(
        row,
        *[
            {
                "variable": F.lit(c),
                "filled": F.col(f"filled_{c}"),
                "invalid": F.col(f"bad_{c}"),
                "invalid_pct": share(F.col(f"bad_{c}"), F.col("rows_")),
            }
            for c in valid
        ],
    )


def code_breakdown(df: DataFrame, col: str, valid: Sequence) -> DataFrame:
    """Distribution of the filled codes, each marked as valid or not."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("is_valid", F.col(col).isin(*valid)).orderBy(col)


def negative_counts(df: DataFrame, cols: Sequence[str] = S.MONEY) -> DataFrame:
    return rule_counts(df, {c: F.col(c) < 0 for c in cols}).withColumnRenamed("rule", "variable")


def total_mismatch(
    df: DataFrame,
    parts: Sequence[str] = S.PARTS,
    zero_if_null: Sequence[str] = (S.CONGESTION, S.AIRPORT),
    tolerance: str = TOLERANCE,
) -> DataFrame:
    gap = F.abs(total_gap(parts, zero_if_null))
    return rule_counts(df, {"total_mismatch": gap > money(tolerance)})


def total_mismatch_top(
    df: DataFrame,
    n: int = 5,
    parts: Sequence[str] = S.PARTS,
    zero_if_null: Sequence[str] = (S.CONGESTION, S.AIRPORT),
    tolerance: str = TOLERANCE,
) -> DataFrame:
    """The most frequent gaps; a tie goes to the smaller gap."""
    gaps = df.select(total_gap(parts, zero_if_null).alias("gap"))
    counts = gaps.where(F.abs("gap") > money(tolerance)).groupBy("gap").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "gap").limit(n)


def fare_formula_flags(df: DataFrame) -> DataFrame:
    """Fares outside what distance and time allow, on trips with both above zero."""
    # Flag drop, rate per mile, rate per minute, floor share, flat fares.
    base, per_mile, per_minute, floor_share = 3.0, 3.5, 0.7, 0.8
    flat, flat_slack, newark_min = "70", "0.50", "23"
    by_distance = F.lit(base) + F.lit(per_mile) * F.col(S.DISTANCE)
    most = by_distance + F.lit(per_minute) * minutes()
    fare, rate = F.col(S.FARE), F.col(S.RATE)
    fare_d = fare.cast("double")
    rows = df.where(fare.isNotNull() & (seconds() > 0) & (F.col(S.DISTANCE) > 0))
    return rule_counts(
        rows,
        {
            "standard_above_max": (rate == 1) & (fare_d > most),
            "standard_severe_under": (rate == 1)
            & (by_distance > base)
            & (fare_d < by_distance * F.lit(floor_share)),
            "jfk_not_flat": (rate == 2) & (fare > 0) & (F.abs(fare - money(flat)) > money(flat_slack)),
            "newark_below_min": (rate == 3) & (fare > 0) & (fare < money(newark_min)),
        },
    )


def tip_checks(df: DataFrame, cash: int = 2, flex: int = 0, card: int = 1) -> DataFrame:
    tipped = F.col(S.TIP) > 0
    pay = F.col(S.PAYMENT)
    return df.agg(
        F.count_if((pay == cash) & tipped).alias("cash_with_tip"),
        F.count_if((pay == flex) & tipped).alias("flex_with_tip"),
        mean(S.TIP, (pay == flex) & tipped).alias("mean_flex_tip"),
        mean(S.TIP, (pay == card) & tipped).alias("mean_card_tip"),
    )


def mta_zero_subgroups(df: DataFrame) -> DataFrame:
    """Standard-rate trips without the state tax, by likely cause; the first cause wins."""
    fare, pay = F.col(S.FARE), F.col(S.PAYMENT)
    # Names of the causes.
    cause = (
        F.when(fare == 0, "fare_zero_likely_voided")
        .when(fare < 0, "fare_negative_reversal")
        .when(pay == 3, "no_charge_trip")
        .when(pay == 4, "dispute_trip")
        .when((fare > 0) & pay.isin(0, 1, 2), "genuine_anomaly")
        .otherwise("other")
    )
    rows = df.where((F.col(S.MTA) == 0) & (F.col(S.RATE) == 1))
    return rows.groupBy(cause.alias("subgroup")).agg(F.count("*").alias("n"))


def _wrong_airport_zone() -> Column:
    return (F.col(S.AIRPORT) > 0) & ~is_in(S.PU, S.AIRPORT_PICKUP_ZONES)


def _wrong_airport_fee(fees: Sequence[str] = S.AIRPORT_FEES) -> Column:
    return (F.col(S.AIRPORT) > 0) & ~F.col(S.AIRPORT).isin(*[money(f) for f in fees])


def airport_fee_anomalies(df: DataFrame) -> DataFrame:
    return rule_counts(
        df,
        {
            "wrong_zone": _wrong_airport_zone(),
            "wrong_amount": _wrong_airport_fee(),
            "either": _wrong_airport_zone() | _wrong_airport_fee(),
        },
    )


def airport_fee_top_zones(df: DataFrame, n: int = 5) -> DataFrame:
    counts = df.where(_wrong_airport_zone()).groupBy(S.PU).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(S.PU)).limit(n)


def airport_fee_amounts(df: DataFrame, fees: Sequence[str] = S.AIRPORT_FEES) -> DataFrame:
    """Charged amounts that are none of the valid fees."""
    counts = df.where(_wrong_airport_fee(fees)).groupBy(S.AIRPORT).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), S.AIRPORT)


def airport_fee_zone_vendors(df: DataFrame, zone: int = 70) -> DataFrame:
    """Vendors behind the fees wrongly charged in one zone."""
    rows = df.where(_wrong_airport_zone() & (F.col(S.PU) == zone))
    counts = rows.groupBy(S.VENDOR).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share_of_all("n")).orderBy(F.desc("n"), S.VENDOR)


def policy_counts(df: DataFrame, policy_date: str = S.POLICY_DATE) -> DataFrame:
    surcharge = F.col(S.IMPROVEMENT)
    return rule_counts(
        df,
        {
            "cbd_fee_before_policy": (F.col(S.PICKUP) < instant(policy_date)) & (F.col(S.CBD) != 0),
            "improvement_old": surcharge == money("0.30"),
            "improvement_current": surcharge == money("1.00"),
            "improvement_reversed": surcharge == money("-1.00"),
        },
    )


def unknown_zone_counts(df: DataFrame, unknown: Sequence[int] = S.UNKNOWN_ZONES) -> DataFrame:
    return rule_counts(
        df,
        {"pickup_unknown": F.col(S.PU).isin(*unknown), "dropoff_unknown": F.col(S.DO).isin(*unknown)},
    )


def rate_check_flat(df: DataFrame, rate: int = 2, fare: str = "70") -> DataFrame:
    value = F.col(S.FARE)
    off = value != money(fare)
    return (
        df.where(F.col(S.RATE) == rate)
        .groupBy(S.VENDOR)
        .agg(
            F.count("*").alias("trips"),
            F.count_if(value == money(fare)).alias("at_flat_fare"),
            F.count_if(off).alias("off_flat_fare"),
            share(F.count_if(value == money(fare)), F.count("*")).alias("pct_at_flat_fare"),
            mean(S.FARE, off).alias("mean_fare_when_off"),
        )
    )


def rate_check_standard(df: DataFrame, rate: int = 1) -> DataFrame:
    # Initial charge, state tax, improvement surcharge.
    checks = {
        "fare_below_initial": F.col(S.FARE) < money("3.00"),
        "fare_negative": F.col(S.FARE) < 0,
        "mta_tax_off": F.col(S.MTA) != money("0.50"),
        "improvement_off": F.col(S.IMPROVEMENT) != money("1.00"),
    }
    measures = []
    for name, check in checks.items():
        measures += [
            F.count_if(check).alias(name),
            share(F.count_if(check), F.count("*")).alias(f"pct_{name}"),
        ]
    rows = df.where(F.col(S.RATE) == rate)
    return rows.groupBy(S.VENDOR).agg(F.count("*").alias("trips"), *measures)


def rate_check_newark(df: DataFrame, rate: int = 3) -> DataFrame:
    low = F.col(S.FARE) < money("3.00")
    no_tolls = F.col(S.TOLLS) == 0
    return (
        df.where(F.col(S.RATE) == rate)
        .groupBy(S.VENDOR)
        .agg(
            F.count("*").alias("trips"),
            F.count_if(low).alias("fare_below_initial"),
            share(F.count_if(low), F.count("*")).alias("pct_fare_below_initial"),
            F.count_if(no_tolls).alias("zero_tolls"),
            share(F.count_if(no_tolls), F.count("*")).alias("pct_zero_tolls"),
            mean(S.FARE).alias("mean_fare"),
            mean(S.TOLLS).alias("mean_tolls"),
        )
    )


def rate_check_negotiated(df: DataFrame, rate: int = 5) -> DataFrame:
    """Median needed, so fares are counted by value first and summarised second."""
    counts = value_counts(
        df.where(F.col(S.RATE) == rate), [S.VENDOR], {"fare": F.col(S.FARE)}
    )
    value, n = F.col("value"), F.col("n")
    return counts.groupBy(S.VENDOR).agg(
        F.sum("n").alias("trips"),
        weighted_count(value <= 0, n).alias("fare_not_positive"),
        share(weighted_count(value <= 0, n), F.sum("n")).alias("pct_fare_not_positive"),
        weighted_mean(value, n).alias("mean_fare"),
        weighted_median(value, n).alias("median_fare"),
        F.max("value").cast("double").alias("max_fare"),
    )


def total_check_by(
    df: DataFrame,
    parts: Sequence[str] = tuple(p for p in S.PARTS if p != S.CBD),
    by: Sequence[str] = (S.VENDOR, S.RATE),
    tolerance: str = TOLERANCE,
) -> DataFrame:
    """Totals that miss their components per group; a null component leaves a row unjudged."""
    gap = F.abs(total_gap(parts))
    off = gap >= money(tolerance)
    return (
        df.where(F.col(S.RATE).isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("trips"),
            F.count_if(off).alias("mismatches"),
            share(F.count_if(off), F.count("*")).alias("pct_mismatches"),
            mean(gap, off).alias("mean_gap_when_off"),
        )
    )


def negative_matrix(
    df: DataFrame,
    codes: Sequence[int] = (0, 3, 4, 6),
    cols: Sequence[str] = tuple(c for c in S.MONEY if c != S.CBD),
) -> DataFrame:
    """Payment type by money column: how often negative, and the mean when it is."""
    measures = []
    for c in cols:
        negative = F.col(c) < 0
        measures += [
            F.count_if(negative).alias(f"n_{c}"),
            mean(c, negative).alias(f"mean_{c}"),
        ]
    row = (
        df.where(F.col(S.PAYMENT).isin(*codes))
        .groupBy(S.PAYMENT)
        .agg(F.count("*").alias("trips"), *measures)
    )
    return in_long_form(
        row,
        *[
            {
                S.PAYMENT: F.col(S.PAYMENT),
                "variable": F.lit(c),
                "trips": F.col("trips"),
                "negative": F.col(f"n_{c}"),
                "negative_pct": share(F.col(f"n_{c}"), F.col("trips")),
                "mean_when_negative": F.col(f"mean_{c}"),
            }
            for c in cols
        ],
    )
