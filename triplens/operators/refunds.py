"""Study of rows with negative amounts, and how they relate to refund pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions import labels as L
from triplens.functions.expressions import either, in_long_form, share, share_of_all
from triplens.functions.stats import how_many, value_counts, weighted_mean, weighted_median
from triplens.operators.duplicates import flag_rows
from triplens.operators.neighbours import dispute_rows, refund_rows
from triplens.sources.shared import broadcast_if_small, pin

NEGATIVE, REFUND = "any_negative", "is_refund_pair"


def any_negative(cols: Sequence[str] = S.MONEY) -> Column:
    """True if some amount is negative; null if none is but one is missing."""
    return either([F.col(c) < 0 for c in cols])


def refund_ids(df: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """Ids of refund pairs and of adjacent disputes, both found on the raw rows."""
    ids = refund_rows(df, levels=levels).union(dispute_rows(df, levels=levels))
    return pin(ids.distinct())


def refund_flag(
    df: DataFrame, levels: Sequence[int] | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Add ``any_negative`` and ``is_refund_pair``; ids that are known already are not sought again."""
    ids = broadcast_if_small(refund_ids(df, levels) if ids is None else ids)
    return flag_rows(df.withColumn(NEGATIVE, any_negative()), ids, REFUND)


def negative_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("trips"), F.count_if(any_negative()).alias("any_negative"))


def negative_vs_refund(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        how_many(flagged, F.col(REFUND)).alias("refund_rows"),
        how_many(flagged, F.col(NEGATIVE) & F.col(REFUND)).alias("negative_in_refund"),
        how_many(flagged, F.col(NEGATIVE) & ~F.col(REFUND)).alias("negative_outside"),
    )


def side() -> Column:
    # Names of the sides.
    return (
        F.when(F.col(S.TOTAL) < 0, "Negative (void)")
        .when(F.col(S.TOTAL) >= 0, "Positive (charge)")
        .otherwise("NA/zero")
    )


def refund_sides(flagged: DataFrame) -> DataFrame:
    counts = flagged.where(REFUND).groupBy(side().alias("side")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share_of_all("n")).orderBy("side")


def split(rows: DataFrame, key: Column, name: str) -> DataFrame:
    counts = rows.groupBy(key.alias(name)).agg(how_many(rows).alias("n"))
    return counts.withColumn("pct", share_of_all("n")).orderBy(F.desc("n"), name)


def negative_by_payment(df: DataFrame) -> DataFrame:
    payment = L.label(S.PAYMENT, L.STUDY_PAYMENT, "Other")
    return split(df.where(any_negative()), payment, "payment")


def negative_by_vendor(df: DataFrame) -> DataFrame:
    vendor = L.label(S.VENDOR, L.STUDY_VENDOR, "Other")
    return split(df.where(any_negative()), vendor, "vendor")


def _orphans(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col(NEGATIVE) & ~F.col(REFUND))


def orphan_negatives(flagged: DataFrame) -> DataFrame:
    """Negative rows outside refund pairs: how many, median and mean total and fare."""
    counts = value_counts(
        _orphans(flagged), [], {"total": F.col(S.TOTAL), "fare": F.col(S.FARE)}
    )
    n = F.col("n")
    total = F.when(F.col("variable") == "total", F.col("value"))
    fare = F.when(F.col("variable") == "fare", F.col("value"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("variable") == "total", n)), F.lit(0)).alias("orphans"),
        weighted_median(total, n).alias("median_total"),
        weighted_mean(total, n).alias("mean_total"),
        weighted_median(fare, n).alias("median_fare"),
        weighted_mean(fare, n).alias("mean_fare"),
    )


def orphan_by_payment(flagged: DataFrame) -> DataFrame:
    return split(_orphans(flagged), L.label(S.PAYMENT, L.STUDY_PAYMENT, "Other"), "payment")


def negative_by_column_split(flagged: DataFrame, cols: Sequence[str] = S.MONEY) -> DataFrame:
    """Per money column with negatives: all, inside refund pairs and outside."""
    measures = []
    for c in cols:
        measures += [
            F.count_if(F.col(c) < 0).alias(f"all_{c}"),
            F.count_if((F.col(c) < 0) & F.col(REFUND)).alias(f"in_{c}"),
        ]
    long = in_long_form(
        flagged.agg(*measures),
        *[
            {
                "variable": F.lit(c),
                "negative": F.col(f"all_{c}"),
                "in_refund": F.col(f"in_{c}"),
                "orphan": F.col(f"all_{c}") - F.col(f"in_{c}"),
                "pct_in_refund": share(F.col(f"in_{c}"), F.col(f"all_{c}")),
            }
            for c in cols
        ],
    )
    return long.where(F.col("negative") > 0).orderBy(F.desc("negative"), "variable")


def negative_monthly(df: DataFrame) -> DataFrame:
    month = F.date_format(S.PICKUP, "yyyy-MM").alias("pickup_month")
    rows = df.where(any_negative())
    return rows.groupBy(month).agg(F.count("*").alias("n")).orderBy("pickup_month")
