"""Studies: named sets of tables that belong together, each set from one count over the trips.

A study does not scan the trips once for each of its tables. It counts them once, by all the
groupings that its tables need (``GROUPING SETS``), stores these counts, which are as many as there are groups and different
amounts, and takes the tables from them. Only rows shown as they are and the
diagnosis of components need a further scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions import labels as L
from triplens.functions.expressions import (
    either,
    exact,
    in_long_form,
    seconds,
    share,
    share_of_all,
)
from triplens.functions.stats import ROWS, how_many, percentiles, weighted_mean, weighted_median
from triplens.operators import discrepancy as D
from triplens.operators import durations as C
from triplens.operators import refunds as R
from triplens.sources.shared import pin


class GroupedCounts:
    """Rows counted by several groupings in one pass; a column of counts marks each part."""

    def __init__(self, rows: DataFrame, groupings: Mapping[str, Sequence[str]], always: Sequence[str] = ()):
        names = list(dict.fromkeys([*always, *[c for g in groupings.values() for c in g]]))
        sets = [[*always, *g] for g in groupings.values()]
        self.columns = dict(zip(groupings, sets, strict=True))
        # The leftmost column has the highest bit, set where it is not part of the grouping.
        self.number = {k: sum(1 << i for i, c in enumerate(reversed(names)) if c not in g) for k, g in self.columns.items()}
        counts = rows.select(*names).groupingSets(sets, *names)
        self.counts = pin(counts.agg(F.grouping_id().alias("_set"), F.count("*").alias(ROWS)))

    def part(self, name: str) -> DataFrame:
        return self.counts.where(F.col("_set") == self.number[name]).select(*self.columns[name], ROWS)


def _nth(counts: DataFrame, value: str, order: Column, n: int) -> Column:
    """The n-th value of counted rows in an order, or the last one. At most n values are looked at."""
    values = counts.groupBy(value).agg(F.sum(ROWS).alias("rows_")).orderBy(order).limit(n)
    before = F.sum("rows_").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    inside = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n)
    return inside.agg(F.max_by(value, "before")).scalar()


def discrepancy_study(trips: DataFrame) -> dict[str, DataFrame]:
    rows = D.add_discrepancy(trips)
    good = ~F.coalesce(F.col(S.VENDOR).isin(*S.BAD_CLOCK_VENDORS), F.lit(False))
    prepared = rows.withColumns(
        {
            "pickup_month": F.date_format(S.PICKUP, "yyyy-MM"),
            "pickup_hour": F.hour(S.PICKUP),
            "zone": D.zone_group(),
            "part_of_day": D.daypart(),
            "era": D.policy_era(),
            "good_clock": good,
            "in_gap_zone": F.col(S.PU).isin(*S.GAP_ZONES),
        }
    )
    counts = GroupedCounts(
        prepared,
        {
            "payment": [S.PAYMENT],
            "vendor": [S.VENDOR],
            "rate": [S.RATE, "implied_rate"],
            "month": ["pickup_month"],
            "hour": ["pickup_hour", "good_clock"],
            "pickup": [S.PU, "good_clock"],
            "dropoff": [S.DO, "good_clock"],
            "zone": ["zone", "part_of_day", "good_clock"],
            "era": ["era"],
            "fee": [S.VENDOR, S.CONGESTION, "in_gap_zone"],
        },
        always=[D.GAP],
    )
    part = {k: counts.part(k) for k in counts.columns}
    clocks = {k: part[k].where("good_clock") for k in ("hour", "pickup", "dropoff", "zone")}
    fees = part["fee"].where("in_gap_zone")
    gaps = part["era"].withColumn("size_", F.abs(D.GAP))
    last = _nth(gaps.where(D.has_gap()), "size_", F.desc("size_"), 20)
    return {
        "overall": D.discrepancy_overall(part["era"]),
        "buckets": D.discrepancy_buckets(part["era"]),
        "signs": D.discrepancy_signs(part["era"]),
        "by_payment": D.by_payment(part["payment"]),
        "cash_tips": D.cash_tip_recon(part["payment"]),
        "by_vendor": D.by_vendor(part["vendor"]),
        "components": D.component_diagnosis(rows),
        "by_month": D.discrepancy_by(part["month"], F.col("pickup_month"), "pickup_month"),
        "medium_band": D.medium_band_eras(part["era"], F.col("era")),
        "modal_values": D.modal_values(part["era"]),
        "modal_values_by_vendor": D.modal_values_by_vendor(part["vendor"]),
        "modal_values_by_era": D.modal_values_by(part["era"], F.col("era"), "era", 10),
        "top_gaps": D.gaps_from(rows, last),
        "rate_changed_crosstab": D.rate_changed_crosstab(part["rate"]),
        "rate_changed_summary": D.rate_changed_summary(part["rate"]),
        "rate_changed_pairs": D.rate_changed_pairs(part["rate"]),
        "zones_by_pickup": D.discrepancy_zone_top(clocks["pickup"]),
        "zones_by_dropoff": D.discrepancy_zone_top(clocks["dropoff"], zone=S.DO),
        "zones_by_rate": D.discrepancy_zone_top(clocks["pickup"], order_by="pct_discrepant"),
        "by_hour": D.discrepancy_by(clocks["hour"], F.col("pickup_hour"), "pickup_hour"),
        "congestion_match": D.congestion_match(fees, None),
        "congestion_inverse": D.congestion_inverse(fees, None),
        "congestion_vendor": D.congestion_vendor(fees, None),
        "by_daypart_zone": D.summarise_gaps(clocks["zone"], ["zone", "part_of_day"]),
        "by_zone_group": D.discrepancy_by(clocks["zone"], F.col("zone"), "zone"),
        "by_rate": D.by_rate(part["rate"]),
    }


def negative_study(trips: DataFrame, ids: DataFrame | None = None) -> dict[str, DataFrame]:
    flagged = R.refund_flag(trips, ids=ids)
    orphan = F.col(R.NEGATIVE) & ~F.col(R.REFUND)
    # One bit for each amount that is negative.
    signs = sum((F.when(F.col(c) < 0, 1 << i).otherwise(0) for i, c in enumerate(S.MONEY)), F.lit(0))
    prepared = flagged.withColumns(
        {
            "pickup_month": F.date_format(S.PICKUP, "yyyy-MM"),
            "side": R.side(),
            "signs": signs,
            "orphan_total": F.when(orphan, F.col(S.TOTAL)),
            "orphan_fare": F.when(orphan, F.col(S.FARE)),
        }
    )
    groupings = {"payment": [S.PAYMENT], "vendor": [S.VENDOR], "month": ["pickup_month"], "side": ["side"], "signs": ["signs"], "total": ["orphan_total"], "fare": ["orphan_fare"]}
    counts = GroupedCounts(prepared, groupings, always=[R.NEGATIVE, R.REFUND])
    part = {k: counts.part(k) for k in groupings}
    negative = {k: p.where(R.NEGATIVE) for k, p in part.items()}
    payment = L.label(S.PAYMENT, L.STUDY_PAYMENT, "Other")
    sides = part["side"].where(R.REFUND)
    n = F.col(ROWS)
    totals, fares = (part[k].where(orphan) for k in ("total", "fare"))
    summary = totals.agg(
        how_many(totals).alias("orphans"),
        weighted_median(F.col("orphan_total"), n).alias("median_total"),
        weighted_mean(F.col("orphan_total"), n).alias("mean_total"),
    )
    of_fares = fares.agg(F.struct(weighted_median(F.col("orphan_fare"), n).alias("median"), weighted_mean(F.col("orphan_fare"), n).alias("mean")))
    summary = summary.withColumn("_f", of_fares.scalar()).select("orphans", "median_total", "mean_total", F.col("_f.median").alias("median_fare"), F.col("_f.mean").alias("mean_fare"))
    return {
        "any_negative": part["signs"].agg(how_many(part["signs"]).alias("trips"), how_many(part["signs"], F.col(R.NEGATIVE)).alias("any_negative")),
        "negative_vs_refund": R.negative_vs_refund(part["signs"]),
        "refund_sides": R.split(sides, F.col("side"), "side"),
        "by_payment": R.split(negative["payment"], payment, "payment"),
        "by_vendor": R.split(negative["vendor"], L.label(S.VENDOR, L.STUDY_VENDOR, "Other"), "vendor"),
        "orphans": summary,
        "orphans_by_payment": R.split(part["payment"].where(orphan), payment, "payment"),
        "by_column": _by_column(part["signs"]),
        "monthly": negative["month"].groupBy("pickup_month").agg(F.sum(ROWS).alias("n")),
    }


def _by_column(signs: DataFrame) -> DataFrame:
    """Per money column with negatives: all, inside refund pairs and outside, from counted sign bits."""
    measures = []
    for i, c in enumerate(S.MONEY):
        below = F.col("signs").bitwiseAND(1 << i) != 0
        measures += [how_many(signs, below).alias(f"all_{c}"), how_many(signs, below & F.col(R.REFUND)).alias(f"in_{c}")]
    long = in_long_form(
        signs.agg(*measures),
        *[
            {
                "variable": F.lit(c),
                "negative": F.col(f"all_{c}"),
                "in_refund": F.col(f"in_{c}"),
                "orphan": F.col(f"all_{c}") - F.col(f"in_{c}"),
                "pct_in_refund": share(F.col(f"in_{c}"), F.col(f"all_{c}")),
            }
            for c in S.MONEY
        ],
    )
    return long.where(F.col("negative") > 0)


def duration_study(trips: DataFrame) -> dict[str, DataFrame]:
    """Each row of the count stands for the trips of one vendor, payment, set of flags and kind of duration."""
    flagged = C.ts_flags(trips)
    duration = seconds()
    states = {"fare_state": F.col(S.FARE) != 0, "distance_state": F.col(S.DISTANCE) != 0}
    prepared = flagged.select(
        "vendor",
        L.label(S.PAYMENT, L.CLOCK_PAYMENT, "Other").alias("payment"),
        *C.FLAGS,
        C.ANY,
        F.signum(duration).cast("int").alias("kind"),
        F.when(duration < 0, duration).alias("below"),
        *[test.alias(name) for name, test in states.items()],
        S.PICKUP,
        S.DROPOFF,
        S.FARE,
        exact(S.DISTANCE).alias("distance"),
    )
    keys = ["vendor", "payment", *C.FLAGS, C.ANY, "kind", "below", *states]
    counts = pin(
        prepared.groupBy(*keys).agg(
            F.count("*").alias(ROWS),
            F.sum(S.FARE).alias("fare"),
            F.count(S.FARE).alias("n_fare"),
            F.sum("distance").alias("distance"),
            F.count("distance").alias("n_distance"),
            F.min(S.PICKUP).alias("earliest_pickup"),
            F.max(S.PICKUP).alias("latest_pickup"),
            F.min(S.DROPOFF).alias("earliest_dropoff"),
            F.max(S.DROPOFF).alias("latest_dropoff"),
        )
    )
    names = (*C.FLAGS, C.ANY)
    zero, negative = F.col("kind") == 0, F.col("below").isNotNull()

    def n(test: Column | None = None) -> Column:
        return how_many(counts, test)

    def average(what: str, test: Column) -> Column:
        return F.try_divide(F.sum(F.when(test, F.col(what))).cast("double"), F.sum(F.when(test, F.col(f"n_{what}"))).cast("double"))

    by_vendor = counts.groupBy("vendor")
    headline = counts.agg(n().alias("rows_"), *[n(F.col(f)).alias(f) for f in names])
    lows = counts.where(negative).select("vendor", F.col("below").alias("value"), F.col(ROWS).alias("n"))
    values = pin(lows.groupBy("vendor", "value").agg(F.sum("n").alias("n")))
    whole = values.groupBy("value").agg(F.sum("n").alias("n"))
    low = [n(negative).alias("negative"), share(n(negative), n()).alias("pct"), (F.min("below").cast("double") / F.lit(60.0)).alias("most_negative")]
    half = (F.col("q")[0].cast("double") / F.lit(60.0)).alias("median_mins")
    medians = percentiles(values, ["vendor"], [0.5]).select("vendor", half)
    fare, distance = zero & F.col("fare_state"), zero & F.col("distance_state")
    with_either = [n(fare).alias("with_fare"), n(distance).alias("with_distance")]
    issues = {"out_of_range": F.col(C.ANY), "negative_duration": F.col("kind") < 0, "zero_duration": zero}
    issues["any_issue"] = either(list(issues.values()))
    group = F.when(zero, "Zero Duration").when(F.col("kind").isNotNull(), "Normal Trip")
    mixed = counts.groupBy(group.alias("trip_group"), "payment").agg(n().alias("n"))
    last = _nth(counts.where(negative), "below", F.asc("below"), 5)
    return {
        "ts_headline": in_long_form(headline, *[{"issue": F.lit(f), "n": F.col(f), "pct": share(F.col(f), F.col("rows_"))} for f in names]),
        "ts_by_vendor": by_vendor.agg(n().alias("trips"), *[n(F.col(f)).alias(f) for f in names], share(n(F.col(C.ANY)), n()).alias("pct_any_ts_issue")),
        "ts_range_by_vendor": by_vendor.agg(*[f(c).alias(c) for f, c in ((F.min, "earliest_pickup"), (F.max, "latest_pickup"), (F.min, "earliest_dropoff"), (F.max, "latest_dropoff"))]),
        "negative_headline": counts.agg(*low).withColumn("median_mins", percentiles(whole, [], [0.5]).select(half).scalar()),
        "negative_by_vendor": by_vendor.agg(n().alias("trips"), *low, average("fare", negative).alias("mean_fare")).join(medians, "vendor", "left"),
        "negative_examples": C.examples_to(trips, last),
        "zero_headline": counts.agg(
            n(zero).alias("zero"),
            share(n(zero), n()).alias("pct"),
            *with_either,
            share(n(fare), n(zero & F.col("fare_state").isNotNull())).alias("pct_with_fare"),
            share(n(distance), n(zero & F.col("distance_state").isNotNull())).alias("pct_with_distance"),
            average("fare", fare).alias("mean_fare"),
            average("distance", distance).alias("mean_distance"),
        ),
        "zero_by_vendor": by_vendor.agg(n().alias("trips"), n(zero).alias("zero"), share(n(zero), n()).alias("pct"), *with_either, average("fare", zero).alias("mean_fare")),
        "zero_vs_rest_payment": mixed.withColumn("pct_within", share_of_all("n", "trip_group")),
        "issues_by_vendor": by_vendor.agg(n().alias("trips"), *[n(t).alias(k) for k, t in issues.items()], *[share(n(t), n()).alias(f"pct_{k}") for k, t in issues.items()]),
    }


# The columns that name a row of each table; tables of one row have none.
KEYS: dict[str, tuple[str, ...]] = {
    "buckets": ("band",), "signs": ("sign",), "by_payment": ("payment",), "by_vendor": ("vendor",), "components": ("component",),
    "by_month": ("pickup_month",), "modal_values": (D.GAP,), "modal_values_by_vendor": ("vendor", "place"),
    "modal_values_by_era": ("era", "place"), "top_gaps": (S.ID,), "rate_changed_crosstab": ("rate_changed", "has_discrepancy"),
    "rate_changed_summary": ("rate_changed",), "rate_changed_pairs": (S.RATE, "implied_rate"), "zones_by_pickup": (S.PU,),
    "zones_by_dropoff": (S.DO,), "zones_by_rate": (S.PU,), "by_hour": ("pickup_hour",), "congestion_inverse": ("has_discrepancy",),
    "congestion_vendor": ("vendor",), "by_daypart_zone": ("zone", "part_of_day"), "by_zone_group": ("zone",), "by_rate": ("rate",),
    "refund_sides": ("side",), "orphans_by_payment": ("payment",), "by_column": ("variable",), "monthly": ("pickup_month",),
    "ts_headline": ("issue",), "ts_by_vendor": ("vendor",), "ts_range_by_vendor": ("vendor",), "negative_by_vendor": ("vendor",),
    "negative_examples": (S.ID,), "zero_by_vendor": ("vendor",), "zero_vs_rest_payment": ("trip_group", "payment"), "issues_by_vendor": ("vendor",),
    "U01_trips_by_date": ("pickup_date",), "U02_trips_by_month": ("pickup_month_label",), "U07_passenger_count": (S.PASSENGERS,),
    "U08_payment_type": ("payment_label",), "U09_ratecode": ("rate_label",), "B01_trips_by_hour": ("pickup_hour",),
    "B02_weekday_demand": ("pickup_weekday",), "B03_payment_behavior": ("payment_label",), "B06_zones_by_trips": (S.PU,),
    "B07_zones_by_revenue": (S.PU,), "M01_month_hour": ("pickup_month_label", "pickup_hour"), "M02_weekday_hour": ("pickup_weekday", "pickup_hour"),
    "M03_zone_hour": (S.PU, "pickup_hour"), "M04_zone_payment": (S.PU, "payment_label"), "M05_distance_duration": ("distance_band", "duration_band"),
    "M06_policy": ("cbd_period",), "zone_revenue": (S.PU,),
}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def cells(table: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """(table_name, row_key, measure, value, text): one row per cell; numbers are values, all else is text."""
    key = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]) if keys else F.lit("all")
    out = []
    for c, t in table.dtypes:
        if c in keys:
            continue
        number = t in _NUMBERS or t.startswith("decimal")
        value = F.col(c).cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else F.col(c).cast("string")
        out.append(F.struct(F.lit(c).alias("measure"), value.alias("value"), text.alias("text")))
    return table.select(F.lit(name).alias("table_name"), key.alias("row_key"), F.inline(F.array(*out)))


def all_cells(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The cells of all tables of a set."""
    out = None
    for name, table in tables.items():
        found = cells(table, name, KEYS.get(name, ()))
        out = found if out is None else out.unionByName(found)
    return out
