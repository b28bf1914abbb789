"""The ordered cleaning of a trip table and the report on what each step did.

Row filters read only columns that no earlier step changes, so one pass can tell for every row
which step drops it first. The report uses that instead of recounting after each step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import (
    in_long_form,
    instant,
    is_in,
    minutes,
    money,
    seconds,
    share,
)
from triplens.operators.duplicates import flag_rows
from triplens.operators.membership import remove_known
from triplens.operators.neighbours import dispute_rows, refund_rows
from triplens.operators.refunds import refund_ids
from triplens.sources.shared import broadcast_if_small

STEP = "first_failed_step"
FILLED = (S.FARE, S.EXTRA, S.MTA, S.TIP, S.TOLLS, S.IMPROVEMENT, S.CONGESTION, S.AIRPORT, S.CBD)


@dataclass(frozen=True)
class Rule:
    """Rows for which ``bad`` holds are dropped; an undecided row too if ``drop_null``."""

    step: int
    label: str
    bad: Column
    drop_null: bool

    def keep(self) -> Column:
        # Plain negation lets the comparison reach the Parquet scan.
        return ~self.bad if self.drop_null else F.coalesce(~self.bad, F.lit(True))

    def drops(self) -> Column:
        return F.coalesce(self.bad, F.lit(self.drop_null))


def row_rules(start: str = S.WINDOW_START, end: str = S.WINDOW_END) -> list[Rule]:
    """The row filters in order. Limits are fixed values."""
    fare, amount = F.col(S.FARE), F.col(S.TOTAL)
    distance = F.col(S.DISTANCE)
    cheap_standard = (F.col(S.RATE) == 1) & (fare < money("4"))
    consistent = (
        ((fare >= money("3")) & (fare <= money("250")))
        & ~cheap_standard
        & (fare <= amount)
        & ((distance > 0) & (distance <= 100))
    )
    pickup = F.col(S.PICKUP)
    return [
        Rule(3, "pickup outside the period", (pickup < instant(start)) | (pickup > instant(end)), True),
        Rule(4, "dropoff before the period", F.col(S.DROPOFF) < instant(start), True),
        Rule(6, "distance not in (0, 100)", (distance <= 0) | (distance >= 100), True),
        Rule(7, "longer than three hours", seconds() > 3 * 3600, False),
        Rule(8, "zone above 263", (F.col(S.PU) > 263) | (F.col(S.DO) > 263), False),
        Rule(
            9,
            "fare out of limits",
            (fare < money("3")) | (fare > money("500")) | cheap_standard | (fare > amount),
            False,
        ),
        Rule(10, "fare and distance not consistent", ~consistent, True),
        Rule(12, "total out of limits", (amount < money("5")) | (amount > money("500")), True),
    ]


LABELS = {
    1: "refund pair",
    2: "adjacent dispute",
    5: "odd duration flagged",
    11: "negative extra set to zero",
    13: "airport fee set from pickup zone",
    14: "nulls set to zero, total recomputed",
}


def duration_flag() -> Column:
    """Zero duration, or a negative one from the vendors with bad clocks."""
    return (seconds() == 0) | (is_in(S.VENDOR, S.BAD_CLOCK_VENDORS) & (seconds() < 0))


def step_refunds(df: DataFrame, levels: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The set of refund ids (found on the raw rows) and the rows without them."""
    ids = broadcast_if_small(refund_rows(df, levels=levels))
    return ids, remove_known(df, ids)


def step_disputes(rest: DataFrame, levels: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The set of adjacent disputes among the rows left by step 1, and the rows without them."""
    ids = broadcast_if_small(dispute_rows(rest, levels=levels))
    return ids, remove_known(rest, ids)


REFUNDS, DISPUTES, PAIRS = "refunds", "disputes", "pairs"


def removal_sets(df: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """(id, kind) of all id sets that need neighbours: what steps 1 and 2 drop, and refund pairs.

    This is the one prepare step of the cleaning and of the refund study: its result can be stored
    and handed to them, which then only join.
    """
    refunds, rest = step_refunds(df, levels)
    disputes, _ = step_disputes(rest, levels)
    kinds = {REFUNDS: refunds, DISPUTES: disputes, PAIRS: refund_ids(df, levels)}
    parts = [ids.select(S.ID, F.lit(kind).alias("kind")) for kind, ids in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def of_kind(sets: DataFrame, *kinds: str) -> DataFrame:
    """The ids of one or more kinds of stored removal sets, sent to all executors if they are few."""
    return broadcast_if_small(sets.where(F.col("kind").isin(*kinds)).select(S.ID))


def negative_extra() -> Column:
    return (F.col(S.EXTRA) < 0) & (F.col(S.FARE) >= 0)


def repair(df: DataFrame, airport_zones: Sequence[int] = S.CLEANING_AIRPORT_ZONES) -> DataFrame:
    """Steps 11, 13 and 14: extra, airport fee, nulls, and then the total from the new parts."""
    extra = F.when(negative_extra(), money(0)).otherwise(F.col(S.EXTRA))
    airport = F.when(is_in(S.PU, airport_zones), money("1.75")).otherwise(money(0))
    changed = df.withColumns(
        {
            c: F.coalesce({S.EXTRA: extra, S.AIRPORT: airport}.get(c, F.col(c)), money(0)).cast(
                S.MONEY_TYPE
            )
            for c in FILLED
        }
    )
    recomputed = sum((F.col(c) for c in FILLED[1:]), F.col(FILLED[0]))
    return changed.withColumn(S.TOTAL, recomputed.cast(S.MONEY_TYPE))


def clean_trips(
    df: DataFrame,
    start: str = S.WINDOW_START,
    end: str = S.WINDOW_END,
    levels: Sequence[int] | None = None,
    sets: DataFrame | None = None,
) -> DataFrame:
    """All steps in order; adds ``duration_mins`` and ``duration_flag``."""
    if sets is None:
        _, rest = step_refunds(df, levels)
        _, rest = step_disputes(rest, levels)
    else:
        # Both sets are known, so the wide rows are tested once.
        rest = remove_known(df, of_kind(sets, REFUNDS, DISPUTES))
    for rule in row_rules(start, end):
        rest = rest.where(rule.keep())
    flagged = rest.withColumns({"duration_mins": minutes(), "duration_flag": duration_flag()})
    return repair(flagged)


def clean_month(df: DataFrame, month: str, sets: DataFrame | None = None) -> DataFrame:
    """The cleaned trips of one pickup month, as cleaning all trips gives them.

    Which trips refunds and disputes take away depends on neighbours of any month, so that is decided on the
    few narrow columns of all trips, unless the sets are stored; wide rows are read for the month alone.
    """
    first = instant(f"{month}-01 00:00:00")
    inside = (F.col(S.PICKUP) >= first) & (F.col(S.PICKUP) < first + F.expr("INTERVAL '1' MONTH"))
    return clean_trips(df.where(inside), sets=removal_sets(df) if sets is None else sets)


def with_failed_step(
    df: DataFrame,
    start: str = S.WINDOW_START,
    end: str = S.WINDOW_END,
    levels: Sequence[int] | None = None,
    sets: DataFrame | None = None,
) -> DataFrame:
    """Add the number of the step that drops the row; null for rows that stay."""
    if sets is None:
        refunds, rest = step_refunds(df, levels)
        disputes, _ = step_disputes(rest, levels)
    else:
        refunds, disputes = of_kind(sets, REFUNDS), of_kind(sets, DISPUTES)
    marked = flag_rows(flag_rows(df, refunds, "_refund"), disputes, "_dispute")
    step = F.when(F.col("_refund"), 1).when(F.col("_dispute"), 2)
    for rule in row_rules(start, end):
        step = step.when(rule.drops(), rule.step)
    return marked.withColumn(STEP, step).drop("_refund", "_dispute")


def _reaches(step: int) -> Column:
    return F.col(STEP).isNull() | (F.col(STEP) > step)


def cleaning_report(marked: DataFrame) -> DataFrame:
    """(step, label, before, dropped, remaining, touched) from one aggregation."""
    rules = {r.step: r.label for r in row_rules()}
    labels = dict(sorted({**LABELS, **rules}.items()))
    touched = {
        5: duration_flag() & _reaches(5),
        11: negative_extra() & _reaches(11),
        13: is_in(S.PU, S.CLEANING_AIRPORT_ZONES) & _reaches(13),
        14: _reaches(14),
    }
    row = marked.agg(
        F.count("*").alias("all_"),
        *[F.count_if(F.col(STEP) == s).alias(f"d{s}") for s in labels],
        *[F.count_if(p).alias(f"t{s}") for s, p in touched.items()],
    )
    records, before = [], F.col("all_")
    for step, text in labels.items():
        after = before - F.col(f"d{step}")
        records.append(
            {
                "step": F.lit(step),
                "label": F.lit(text),
                "before": before,
                "dropped": F.col(f"d{step}"),
                "remaining": after,
                "touched": F.col(f"t{step}") if step in touched else F.lit(None).cast("bigint"),
            }
        )
        before = after
    return in_long_form(row, *records)


def cleaning_total(marked: DataFrame) -> DataFrame:
    stays = F.col(STEP).isNull()
    return marked.agg(
        F.count("*").alias("original"),
        F.count_if(stays).alias("final"),
        F.count_if(~stays).alias("dropped"),
        share(F.count_if(~stays), F.count("*")).alias("pct_dropped"),
        F.count_if(stays & duration_flag()).alias("flagged_kept"),
    )


def revenue_by_vendor(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Revenue before and after cleaning side by side."""
    none = F.lit(None).cast(S.MONEY_TYPE)
    both = raw.select(S.VENDOR, F.col(S.TOTAL).alias("raw"), none.alias("clean")).unionAll(
        clean.select(S.VENDOR, none.alias("raw"), F.col(S.TOTAL).alias("clean"))
    )
    return both.groupBy(S.VENDOR).agg(
        F.sum("raw").cast("double").alias("revenue_before"),
        F.sum("clean").cast("double").alias("revenue_after"),
    )


def fit_quality(marked: DataFrame) -> DataFrame:
    """Correlation of distance and fare, and adjusted R2 of a line, before and after cleaning."""
    distance, fare = F.col(S.DISTANCE), F.col(S.FARE).cast("double")
    after_10, stays = _reaches(10), F.col(STEP).isNull()

    def corr(where: Column) -> Column:
        return F.corr(F.when(where, distance), F.when(where, fare))

    sums = marked.agg(
        corr(after_10).alias("corr_after_step_10"),
        corr(stays).alias("corr_final"),
        F.regr_r2(distance, fare).alias("r2_before"),
        F.regr_count(distance, fare).alias("n_before"),
        F.regr_r2(F.when(stays, distance), F.when(stays, fare)).alias("r2_after"),
        F.regr_count(F.when(stays, distance), F.when(stays, fare)).alias("n_after"),
    )

    def adjusted(when: str) -> Column:
        r2, n = F.col(f"r2_{when}"), F.col(f"n_{when}")
        return F.lit(1.0) - (F.lit(1.0) - r2) * F.try_divide(n - 1, n - 2)

    return sums.select(
        "corr_after_step_10",
        "corr_final",
        adjusted("before").alias("adj_r2_before"),
        adjusted("after").alias("adj_r2_after"),
    )
