"""Study of timestamps outside the period and of negative and zero durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions import labels as L
from triplens.functions.expressions import (
    either,
    exact,
    in_long_form,
    instant,
    mean,
    minutes,
    seconds,
    share,
    share_of_all,
)
from triplens.functions.stats import percentiles, weighted_count
from triplens.sources.shared import pin

FLAGS = (
    "pickup_before_window",
    "pickup_after_window",
    "dropoff_before_window",
    "dropoff_after_window",
)
ANY = "any_ts_issue"


def ts_flags(
    df: DataFrame, start: str = S.WINDOW_START, after: str = S.AFTER_WINDOW
) -> DataFrame:
    """Add the vendor's name, the duration and one flag per way to leave the period."""
    tests = (
        F.col(S.PICKUP) < instant(start),
        F.col(S.PICKUP) >= instant(after),
        F.col(S.DROPOFF) < instant(start),
        F.col(S.DROPOFF) >= instant(after),
    )
    return df.withColumns(
        {
            "vendor": L.label(S.VENDOR, L.CLOCK_VENDOR, "Unknown"),
            "duration_mins": minutes(),
            **dict(zip(FLAGS, tests, strict=True)),
            ANY: either(tests),
        }
    )


def ts_headline(df: DataFrame) -> DataFrame:
    flagged = ts_flags(df)
    names = (*FLAGS, ANY)
    row = flagged.agg(
        F.count("*").alias("rows_"), *[F.count_if(F.col(f)).alias(f) for f in names]
    )
    return in_long_form(
        row,
        *[
            {"issue": F.lit(f), "n": F.col(f), "pct": share(F.col(f), F.col("rows_"))}
            for f in names
        ],
    )


def ts_by_vendor(df: DataFrame) -> DataFrame:
    names = (*FLAGS, ANY)
    return (
        ts_flags(df)
        .groupBy("vendor")
        .agg(
            F.count("*").alias("trips"),
            *[F.count_if(F.col(f)).alias(f) for f in names],
            share(F.count_if(F.col(ANY)), F.count("*")).alias("pct_any_ts_issue"),
        )
        .orderBy(F.desc(ANY), "vendor")
    )


def ts_range_by_vendor(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(L.label(S.VENDOR, L.CLOCK_VENDOR, "Unknown").alias("vendor"))
        .agg(
            F.min(S.PICKUP).alias("earliest_pickup"),
            F.max(S.PICKUP).alias("latest_pickup"),
            F.min(S.DROPOFF).alias("earliest_dropoff"),
            F.max(S.DROPOFF).alias("latest_dropoff"),
        )
        .orderBy("vendor")
    )


def _negative_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows counted by their negative duration; all others share the null entry."""
    below = F.when(seconds() < 0, seconds())
    rows = df.select(*by, below.alias("below"), exact(S.FARE).alias("fare"))
    return rows.groupBy(*by, "below").agg(
        F.count("*").alias("n"), F.sum("fare").alias("fare"), F.count("fare").alias("n_fare")
    )


def _in_minutes(value: Column) -> Column:
    return value.cast("double") / F.lit(60.0)


def _medians(counts: DataFrame, *by: str) -> DataFrame:
    """(by.., median_mins) of counted durations, which may be as many as the rows."""
    values = counts.where("below is not null").select(*by, F.col("below").alias("value"), "n")
    found = percentiles(values, by, [0.5])
    return found.select(*by, _in_minutes(F.col("q")[0]).alias("median_mins"))


def neg_duration_headline(df: DataFrame) -> DataFrame:
    n, below = F.col("n"), F.col("below")
    negative = weighted_count(below.isNotNull(), n)
    counts = pin(_negative_counts(df))
    row = counts.agg(
        negative.alias("negative"),
        share(negative, F.sum(n)).alias("pct"),
        F.min(_in_minutes(below)).alias("most_negative"),
    )
    return row.withColumn("median_mins", _medians(counts).scalar())


def neg_duration_by_vendor(df: DataFrame) -> DataFrame:
    n, below = F.col("n"), F.col("below")
    negative = weighted_count(below.isNotNull(), n)
    named = df.withColumn("vendor", L.label(S.VENDOR, L.CLOCK_VENDOR, "Unknown"))
    fares = F.sum(F.when(below.isNotNull(), F.col("fare"))).cast("double")
    filled = F.sum(F.when(below.isNotNull(), F.col("n_fare"))).cast("double")
    counts = pin(_negative_counts(named, "vendor"))
    rows = counts.groupBy("vendor").agg(
        F.sum(n).alias("trips"),
        negative.alias("negative"),
        share(negative, F.sum(n)).alias("pct"),
        F.min(_in_minutes(below)).alias("most_negative"),
        F.try_divide(fares, filled).alias("mean_fare"),
    )
    return rows.join(_medians(counts, "vendor"), "vendor", "left").orderBy(F.desc("negative"), "vendor")


def examples_to(df: DataFrame, last: Column) -> DataFrame:
    """The negative durations up to a given number of seconds."""
    rows = ts_flags(df).where((seconds() < 0) & (seconds() <= last))
    return rows.select(S.ID, "vendor", S.PICKUP, S.DROPOFF, "duration_mins", S.FARE, S.TOTAL, S.PAYMENT)


def neg_duration_examples(df: DataFrame, n: int = 5) -> DataFrame:
    """The n most negative durations with all ties of the last one kept."""
    top = df.select(seconds().alias("seconds_")).where(F.col("seconds_") < 0).orderBy("seconds_").limit(n)
    return examples_to(df, top.agg(F.max("seconds_").alias("last")).scalar())


def zero_duration_headline(df: DataFrame) -> DataFrame:
    zero = seconds() == 0
    fare, distance = zero & (F.col(S.FARE) != 0), zero & (F.col(S.DISTANCE) != 0)
    return df.agg(
        F.count_if(zero).alias("zero"),
        share(F.count_if(zero), F.count("*")).alias("pct"),
        F.count_if(fare).alias("with_fare"),
        share(F.count_if(fare), F.count_if(zero & F.col(S.FARE).isNotNull())).alias("pct_with_fare"),
        F.count_if(distance).alias("with_distance"),
        share(F.count_if(distance), F.count_if(zero & F.col(S.DISTANCE).isNotNull())).alias(
            "pct_with_distance"
        ),
        mean(S.FARE, fare).alias("mean_fare"),
        mean(S.DISTANCE, distance).alias("mean_distance"),
    )


def zero_duration_by_vendor(df: DataFrame) -> DataFrame:
    zero = seconds() == 0
    return (
        df.groupBy(L.label(S.VENDOR, L.CLOCK_VENDOR, "Unknown").alias("vendor"))
        .agg(
            F.count("*").alias("trips"),
            F.count_if(zero).alias("zero"),
            share(F.count_if(zero), F.count("*")).alias("pct"),
            F.count_if(zero & (F.col(S.FARE) != 0)).alias("with_fare"),
            F.count_if(zero & (F.col(S.DISTANCE) != 0)).alias("with_distance"),
            mean(S.FARE, zero).alias("mean_fare"),
        )
        .orderBy(F.desc("zero"), "vendor")
    )


def zero_vs_rest_payment(df: DataFrame) -> DataFrame:
    """Payment mix inside zero-duration trips and inside all others."""
    # Names of the two groups.
    group = F.when(seconds() == 0, "Zero Duration").when(seconds().isNotNull(), "Normal Trip")
    payment = L.label(S.PAYMENT, L.CLOCK_PAYMENT, "Other")
    counts = df.groupBy(group.alias("trip_group"), payment.alias("payment")).agg(
        F.count("*").alias("n")
    )
    return counts.withColumn("pct_within", share_of_all("n", "trip_group")).orderBy(
        "trip_group", F.desc("n"), "payment"
    )


def issues_by_vendor(df: DataFrame) -> DataFrame:
    """The three kinds of issues side by side per vendor."""
    issues = {
        "out_of_range": F.col(ANY),
        "negative_duration": F.col("duration_mins") < 0,
        "zero_duration": F.col("duration_mins") == 0,
    }
    issues["any_issue"] = either(list(issues.values()))
    return (
        ts_flags(df)
        .groupBy("vendor")
        .agg(
            F.count("*").alias("trips"),
            *[F.count_if(p).alias(name) for name, p in issues.items()],
            *[share(F.count_if(p), F.count("*")).alias(f"pct_{name}") for name, p in issues.items()],
        )
        .orderBy(F.desc("any_issue"), "vendor")
    )
