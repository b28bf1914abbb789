"""Study of totals that differ from the sum of their components.

Every summary needs medians of the gap. Gaps are exact cents, so rows are first counted by
(group, gap), which combines on the map side, and all figures come from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions import labels as L
from triplens.functions.expressions import (
    in_long_form,
    instant,
    is_in,
    minutes,
    money,
    seconds,
    share,
    share_of_all,
    total_gap,
)
from triplens.functions.stats import (
    counted,
    how_many,
    weighted_count,
    weighted_mean,
    weighted_median,
    weighted_percentile,
)

GAP = "discrepancy"
FILLED = (S.CONGESTION, S.AIRPORT, S.CBD)

# Size bands of a gap, upper edge and name, and the names of the signs.
BANDS = (
    ("0.01", "Exact / rounding (<$0.01)"),
    ("0.50", "Tiny ($0.01–$0.49)"),
    ("1.00", "Small ($0.50–$0.99)"),
    ("5.00", "Medium ($1–$4.99)"),
    ("10.00", "Large ($5–$9.99)"),
    ("50.00", "Very large ($10–$49.99)"),
)
LARGEST_BAND = "Extreme (>=$50)"
SIGN_EXACT, SIGN_MORE, SIGN_LESS = "Exact", "Positive (total > sum)", "Negative (total < sum)"

# Parts of the day by pickup hour.
DAYPARTS = (
    ((6, 11), "Morning (6–11)"),
    ((12, 16), "Afternoon (12–16)"),
    ((17, 19), "Rush Hour (17–19)"),
)
NIGHT = "Night (20–5)"


def implied_rate(
    jfk: Sequence[int] = S.JFK_ZONES, suburban: Sequence[int] = S.SUBURBAN_ZONES
) -> Column:
    """Rate code that the two zones suggest; the first match wins."""
    return (
        F.when(is_in(S.PU, jfk) | is_in(S.DO, jfk), 2)
        .when((F.col(S.PU) == 1) & (F.col(S.DO) == 1), 3)
        .when(is_in(S.PU, suburban) | is_in(S.DO, suburban), 4)
        .otherwise(1)
    )


def add_discrepancy(df: DataFrame) -> DataFrame:
    """Gap, rule-based gap, implied rate and duration and sign flags.

    The three optional fees are filled in a first step, because later columns read the filled
    values.
    """
    filled = df.withColumns({c: F.coalesce(F.col(c), money(0)) for c in FILLED})
    expected_mta = F.when(F.col(S.RATE) == 1, money("0.50")).when(F.col(S.RATE).isNotNull(), money(0))
    expected_parts = (
        F.col(S.FARE) + F.col(S.EXTRA) + expected_mta + money("1.00") + F.col(S.TOLLS)
        + F.col(S.CONGESTION) + F.col(S.AIRPORT) + F.col(S.CBD) + F.col(S.TIP)
    )
    duration = seconds()
    return filled.withColumns(
        {
            GAP: total_gap(),
            "expected_discrepancy": (F.col(S.TOTAL) - expected_parts).cast("decimal(14,2)"),
            "implied_rate": implied_rate(),
            "duration_mins": minutes(),
            "duration_issue": F.when(duration == 0, "zero_duration").when(
                (duration < 0) & is_in(S.VENDOR, S.BAD_CLOCK_VENDORS), "negative_duration_v6_v7"
            ),
            "has_negative_amount": (F.col(S.TOTAL) < 0) | (F.col(S.FARE) < 0),
        }
    )


def has_gap() -> Column:
    return F.abs(GAP) >= money("0.01")


def gap_band(gap: str = GAP) -> Column:
    out = F
    for edge, name in BANDS:
        out = out.when(F.abs(gap) < money(edge), name)
    return out.otherwise(LARGEST_BAND)


def gap_sign(gap: str = GAP) -> Column:
    return (
        F.when(F.abs(gap) < money("0.01"), SIGN_EXACT)
        .when(F.col(gap) > 0, SIGN_MORE)
        .otherwise(SIGN_LESS)
    )


def add_discrepancy_bands(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "abs_discrepancy": F.abs(GAP),
            "has_discrepancy": has_gap(),
            "discrepancy_band": gap_band(),
            "discrepancy_sign": gap_sign(),
        }
    )


def gap_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, GAP).agg(how_many(df).alias("n"))


def summarise_gaps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, discrepant rows and their median and mean gap per group."""
    n, gap = F.col("n"), F.when(has_gap(), F.col(GAP))
    return (
        gap_counts(df, *by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("trips"),
            weighted_count(has_gap(), n).alias("discrepant"),
            share(weighted_count(has_gap(), n), F.sum("n")).alias("pct_discrepant"),
            weighted_median(gap, n).alias("median_gap"),
            weighted_mean(gap, n).alias("mean_gap"),
        )
    )


def discrepancy_overall(df: DataFrame) -> DataFrame:
    """One row: how many rows are off, and the spread of their gaps."""
    n, gap = F.col("n"), F.when(has_gap(), F.col(GAP))
    off = F.col("discrepant")
    # Reported percentiles.
    probs = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    sums = gap_counts(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("trips"),
        weighted_count(has_gap(), n).alias("discrepant"),
        F.sum(gap * n).cast("double").alias("s1"),
        F.sum(gap * gap * n).cast("double").alias("s2"),
        weighted_percentile(gap, list(probs.values()), n).alias("q"),
        F.min(gap).cast("double").alias("min"),
        F.max(gap).cast("double").alias("max"),
    )
    spread = F.try_divide(F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), off), off - 1)
    return sums.select(
        "trips",
        "discrepant",
        (F.col("trips") - off).alias("exact"),
        share(off, F.col("trips")).alias("pct_discrepant"),
        F.try_divide("s1", off).alias("mean"),
        F.sqrt(F.when(spread < 0, 0.0).otherwise(spread)).alias("sd"),
        *[F.col("q")[i].alias(name) for i, name in enumerate(probs)],
        "min",
        "max",
    )


def discrepancy_buckets(df: DataFrame) -> DataFrame:
    """Rows per size band, in band order, as share of all and of discrepant rows."""
    names = [name for _, name in BANDS] + [LARGEST_BAND]
    position = F
    for i, name in enumerate(names):
        position = position.when(F.col("band") == name, i)
    counts = df.groupBy(gap_band().alias("band")).agg(how_many(df).alias("n"))
    off = F.when(F.col("band") != names[0], F.col("n")).otherwise(0)
    return (
        counts.withColumns({"position": position, "off": off})
        .withColumns({"pct_of_rows": share_of_all("n"), "all_off": F.sum("off").over(Window.partitionBy())})
        .select(
            "position",
            "band",
            "n",
            "pct_of_rows",
            share(F.col("n"), F.col("all_off")).alias("pct_of_discrepant"),
        )
        .orderBy("position")
    )


def discrepancy_signs(df: DataFrame) -> DataFrame:
    counts = df.groupBy(gap_sign().alias("sign")).agg(how_many(df).alias("n"))
    return counts.withColumn("pct", share_of_all("n")).orderBy(F.desc("n"), "sign")


def discrepancy_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return summarise_gaps(df.select(key.alias(name), GAP, *counted(df)), [name])


def by_payment(df: DataFrame) -> DataFrame:
    return discrepancy_by(df, L.label(S.PAYMENT, L.STUDY_PAYMENT, "Other"), "payment")


def by_vendor(df: DataFrame) -> DataFrame:
    return discrepancy_by(df, L.label(S.VENDOR, L.STUDY_VENDOR, "Other"), "vendor")


def by_month(df: DataFrame) -> DataFrame:
    return discrepancy_by(df, F.date_format(S.PICKUP, "yyyy-MM"), "pickup_month")


def by_rate(df: DataFrame) -> DataFrame:
    return discrepancy_by(df, L.label(S.RATE, L.STUDY_RATE, "Other"), "rate")


def good_clocks(df: DataFrame, bad: Sequence[int] = S.BAD_CLOCK_VENDORS) -> DataFrame:
    """Without the vendors whose timestamps cannot be trusted; a null vendor stays."""
    return df.where(~is_in(S.VENDOR, bad))


def by_hour(df: DataFrame) -> DataFrame:
    return discrepancy_by(good_clocks(df), F.hour(S.PICKUP), "pickup_hour")


def zone_group(zones: Sequence[int] = S.CONGESTION_ZONES) -> Column:
    return F.when(is_in(S.PU, zones), "Congestion Zone").otherwise("Outside Zone")


def by_zone_group(df: DataFrame) -> DataFrame:
    return discrepancy_by(good_clocks(df), zone_group(), "zone")


def daypart() -> Column:
    hour = F.hour(S.PICKUP)
    out = F
    for (first, last), name in DAYPARTS:
        out = out.when(hour.between(first, last), name)
    return out.when(hour.isNotNull(), NIGHT)


def discrepancy_by_daypart_zone(df: DataFrame) -> DataFrame:
    rows = good_clocks(df).select(
        zone_group().alias("zone"), daypart().alias("part_of_day"), GAP
    )
    return summarise_gaps(rows, ["zone", "part_of_day"]).orderBy("zone", "part_of_day")


def cash_tip_recon(df: DataFrame, cash: int = 2, plausible: str = "50") -> DataFrame:
    """Cash rows whose total exceeds the parts: could the gap be an unrecorded tip?"""
    rows = df.where((F.col(S.PAYMENT) == cash) & (F.col(GAP) > money("0.01")))
    n, gap = F.col("n"), F.col(GAP)
    return gap_counts(rows).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cash_rows"),
        weighted_count(gap < money(plausible), n).alias("plausible_tip"),
        weighted_median(F.when(gap < money(plausible), gap), n).alias("median_plausible_tip"),
    )


def component_diagnosis(df: DataFrame, parts: Sequence[str] = S.PARTS) -> DataFrame:
    """On discrepant rows: how often each component is zero, null or negative."""
    measures = []
    for p in parts:
        measures += [
            F.count_if(F.col(p) == 0).alias(f"zero_{p}"),
            F.count_if(F.col(p).isNull()).alias(f"null_{p}"),
            F.count_if(F.col(p) < 0).alias(f"neg_{p}"),
        ]
    row = df.where(has_gap()).agg(F.count("*").alias("rows_"), *measures)
    return in_long_form(
        row,
        *[
            {
                "component": F.lit(p),
                "n_zero": F.col(f"zero_{p}"),
                "pct_zero": share(F.col(f"zero_{p}"), F.col("rows_")),
                "n_null": F.col(f"null_{p}"),
                "pct_null": share(F.col(f"null_{p}"), F.col("rows_")),
                "n_negative": F.col(f"neg_{p}"),
            }
            for p in parts
        ],
    ).orderBy(F.desc("n_zero"), "component")


def _medium(df: DataFrame, low: str = "1", high: str = "5") -> DataFrame:
    return df.where((F.abs(GAP) >= money(low)) & (F.abs(GAP) < money(high)))


def modal_values(df: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent exact gaps of the medium band, with their share of the band.

    The band holds at most 800 different cent values, so the share window is small.
    """
    counts = gap_counts(_medium(df)).withColumn("pct_of_band", share_of_all("n"))
    return counts.orderBy(F.desc("n"), GAP).limit(k)


def policy_era(policy_date: str = S.POLICY_DATE) -> Column:
    when = F.col(S.PICKUP)
    return F.when(when >= instant(policy_date), "post_cbd").when(when.isNotNull(), "pre_cbd")


def modal_values_by(df: DataFrame, key: Column, name: str, k: int) -> DataFrame:
    """The k most frequent gaps of the medium band per group; ties are cut, smaller gap first."""
    counts = gap_counts(_medium(df).select(key.alias(name), GAP, *counted(df)), name)
    order = Window.partitionBy(name).orderBy(F.desc("n"), GAP)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def modal_values_by_vendor(df: DataFrame, k: int = 5) -> DataFrame:
    return modal_values_by(df, L.label(S.VENDOR, L.SHORT_VENDOR, "Other"), "vendor", k)


def modal_values_by_era(df: DataFrame, k: int = 10) -> DataFrame:
    return modal_values_by(df, policy_era(), "era", k)


def medium_band_eras(df: DataFrame, era: Column | None = None) -> DataFrame:
    era = policy_era() if era is None else era
    return _medium(df).agg(
        how_many(df).alias("rows_in_band"),
        how_many(df, era == "pre_cbd").alias("pre_cbd"),
        how_many(df, era == "post_cbd").alias("post_cbd"),
    )


def gaps_from(df: DataFrame, least: Column) -> DataFrame:
    """The discrepant rows whose gap has at least a given size."""
    rows = df.where(has_gap()).withColumn("abs_discrepancy", F.abs(GAP))
    return rows.where(F.col("abs_discrepancy") >= least).select(
        S.ID, S.PICKUP, S.VENDOR, S.PAYMENT, S.FARE, S.TIP, S.TOTAL, GAP, "expected_discrepancy"
    )


def top_gaps(df: DataFrame, n: int = 20) -> DataFrame:
    """The n largest gaps with all ties of the last one kept.

    The n-th largest size comes from a top-n and filters the table: no global sort or window.
    """
    sizes = df.where(has_gap()).select(F.abs(GAP).alias("abs_discrepancy"))
    top = sizes.orderBy(F.desc("abs_discrepancy")).limit(n)
    return gaps_from(df, top.agg(F.min("abs_discrepancy").alias("last")).scalar())


def rate_changed() -> Column:
    return F.coalesce(F.col(S.RATE) != F.col("implied_rate"), F.lit(False))


def rate_changed_crosstab(df: DataFrame) -> DataFrame:
    counts = df.groupBy(
        rate_changed().alias("rate_changed"), has_gap().alias("has_discrepancy")
    ).agg(how_many(df).alias("n"))
    return counts.withColumn("pct_within", share_of_all("n", "rate_changed")).orderBy(
        "rate_changed", "has_discrepancy"
    )


def rate_changed_summary(df: DataFrame) -> DataFrame:
    return discrepancy_by(df, rate_changed(), "rate_changed")


def rate_changed_pairs(df: DataFrame) -> DataFrame:
    counts = (
        df.where(rate_changed())
        .groupBy(S.RATE, "implied_rate")
        .agg(
            how_many(df).alias("trips"),
            how_many(df, has_gap()).alias("discrepant"),
            share(how_many(df, has_gap()), how_many(df)).alias("pct_discrepant"),
        )
    )
    return counts.orderBy(F.desc("trips"), S.RATE, "implied_rate")


def discrepancy_zone_top(
    df: DataFrame,
    zone: str = S.PU,
    order_by: str = "discrepant",
    min_trips: int = 100,
    n: int = 20,
) -> DataFrame:
    """Zones with enough trips, the highest by count or by rate; a tie goes to the lower zone.

    Counted rows are those of good clocks already.
    """
    zones = summarise_gaps(df if counted(df) else good_clocks(df), [zone]).drop("mean_gap")
    return (
        zones.where(F.col("trips") >= min_trips)
        .orderBy(F.desc(order_by), F.asc_nulls_last(zone))
        .limit(n)
    )


def _picked_up_in(df: DataFrame, zones: Sequence[int] | None) -> DataFrame:
    """Rows of the given pickup zones; None if the rows were chosen already."""
    return df if zones is None else df.where(F.col(S.PU).isin(*zones))


def congestion_match(df: DataFrame, zones: Sequence[int] | None = S.GAP_ZONES) -> DataFrame:
    """Is the gap on discrepant rows just the congestion surcharge?"""
    match = F.abs(F.col(GAP) - F.col(S.CONGESTION)) < money("0.01")
    return _picked_up_in(df, zones).where(has_gap()).agg(
        how_many(df).alias("discrepant"),
        how_many(df, match).alias("matching"),
        share(how_many(df, match), how_many(df)).alias("pct_matching"),
    )


def congestion_inverse(df: DataFrame, zones: Sequence[int] | None = S.GAP_ZONES) -> DataFrame:
    """Do discrepant rows differ from the others in being charged the surcharge at all?"""
    fee = F.coalesce(F.col(S.CONGESTION), money(0))
    counts = _picked_up_in(df, zones).groupBy(has_gap().alias("has_discrepancy"), fee.alias("fee")).agg(how_many(df).alias("n"))
    value, n = F.col("fee"), F.col("n")
    return counts.groupBy("has_discrepancy").agg(
        F.sum("n").alias("trips"),
        share(weighted_count(value == 0, n), F.sum("n")).alias("pct_zero_surcharge"),
        weighted_median(value, n).alias("median_surcharge"),
        weighted_mean(value, n).alias("mean_surcharge"),
    )


def congestion_vendor(df: DataFrame, zones: Sequence[int] | None = S.GAP_ZONES) -> DataFrame:
    vendor = L.label(S.VENDOR, L.SHORT_VENDOR, "Other").alias("vendor")
    counts = _picked_up_in(df, zones).where(has_gap()).groupBy(vendor).agg(how_many(df).alias("n"))
    return counts.withColumn("pct", share_of_all("n")).orderBy(F.desc("n"), "vendor")
