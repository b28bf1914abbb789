"""Exact copies, near copies, and how the two records of a pair relate to each other.

Summaries never go back to the rows: one aggregation per group keeps all they need, and it
combines on the map side, so a group that holds a third of the table is no problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import (
    both,
    cents,
    from_cents,
    money,
    share,
    share_of_all,
)
from triplens.functions.stats import weighted_median
from triplens.sources.shared import broadcast_if_small, pin

GROUP = "dup_group_id"
CENT = "0.01"
# A group is a row of up to all columns, a few hundred bytes.
BROADCAST_GROUPS = 100_000
CORE = (S.FARE, S.EXTRA, S.MTA, S.IMPROVEMENT)
SURCHARGES = (S.CONGESTION, S.AIRPORT, S.CBD, S.TOLLS)
NULL_AS_ZERO = (S.CONGESTION, S.AIRPORT, S.CBD)

# Names of the pair categories.
SAME_SIGN = "A_same_sign_double_charge"
MIRROR = "B_exact_mirror_void"
EXCEPT_TIP = "C_mirror_except_tip"
EXCEPT_SURCHARGE = "D_mirror_except_surcharge"
EXCEPT_BOTH = "E_mirror_except_tip_and_surcharge"
CORE_DIFFERS = "F_partial_void_core_differs"
OTHER = "G_other_unclassified"
MORE_THAN_TWO = "H_group_size_gt_2"


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys hash like those of another row: all rows of groups, and few others.

    Only a hash of eight bytes per row is shuffled to count it, and only rows with a repeated hash
    are left for what compares the keys themselves. Doubles are hashed without negative zero.
    """
    kinds = dict(df.dtypes)
    plain = [F.col(k) + F.lit(0.0) if kinds[k] in ("double", "float") else F.col(k) for k in keys]
    hashed = F.xxhash64(*plain)
    twice = df.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    seen = broadcast_if_small(pin(twice))
    return df.join(seen, hashed == F.col("_hash"), "left_semi")


def dup_groups(df: DataFrame, keys: Sequence[str], key: str = S.ID) -> DataFrame:
    """Groups of rows equal on all keys (null equals null): id, keys and size.

    The smallest row id names the group: unique, repeatable and without a global ranking.
    """
    rows = repeated_keys(df, keys)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(key).alias(GROUP))
    return groups.where(F.col("n") > 1)


def dup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows and groups share all keys."""
    return dup_groups(df, keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_groups")
    )


def dup_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of all groups with their group id.

    The groups are pinned and counted: if few, they go to all executors and no row is moved.
    If many, it is a shuffle join, in which adaptive execution can split the rows of a hot group.
    A window could not do that: it needs a whole group in one task.
    """
    groups = pin(dup_groups(df, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], GROUP))
    same = both([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(broadcast_if_small(groups, BROADCAST_GROUPS), same).select(*df.columns, GROUP)


def content_columns(df: DataFrame, exclude: Sequence[str] = (S.ID,)) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def exact_dups(df: DataFrame, exclude: Sequence[str] = (S.ID,)) -> DataFrame:
    """Rows equal to another one on every column that is not excluded."""
    return dup_rows(df, content_columns(df, exclude))


def exact_dup_counts(df: DataFrame, exclude: Sequence[str] = (S.ID,)) -> DataFrame:
    return dup_counts(df, content_columns(df, exclude))


def repeated_ids(df: DataFrame, key: str = S.ID) -> DataFrame:
    return dup_counts(df, [key])


def pair_features(df: DataFrame, keys: Sequence[str] = S.STRICT_KEYS) -> DataFrame:
    """One row per group of two or more near copies: signs, sums, first and last amounts.

    A sum is null if one of its values is, except for the optional fees.
    """
    fare = F.col(S.FARE)
    strict = [c for c in S.MONEY if c not in NULL_AS_ZERO]
    # One bit per strict column that is null in some row: a single long instead of ten counts.
    nulls = sum(
        (F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(strict)), F.lit(0)
    )
    groups = repeated_keys(df, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(S.ID).alias(GROUP),
        F.count_if(fare > 0).alias("n_pos_fare"),
        F.count_if(fare < 0).alias("n_neg_fare"),
        F.count_if(fare == 0).alias("n_zero_fare"),
        F.min(fare).alias("min_fare"),
        F.max(fare).alias("max_fare"),
        F.bit_or(nulls).alias("nulls"),
        *[F.sum(cents(c)).alias(f"c_{c}") for c in S.MONEY],
        F.min_by(S.TOTAL, S.ID).alias("row1_total"),
        F.max_by(S.TOTAL, S.ID).alias("row2_total"),
        F.min_by(S.FARE, S.ID).alias("row1_fare"),
        F.max_by(S.FARE, S.ID).alias("row2_fare"),
    )

    def summed(c: str) -> Column:
        value = from_cents(F.col(f"c_{c}"))
        if c in NULL_AS_ZERO:
            return F.coalesce(value, money(0))
        return F.when(F.col("nulls").bitwiseAND(1 << strict.index(c)) == 0, value)

    return (
        groups.where(F.col("n") > 1)
        .withColumns({f"sum_{c}": summed(c) for c in S.MONEY})
        .drop("nulls", *[f"c_{c}" for c in S.MONEY])
    )


def _cancels(*cols: str) -> Column:
    return both([F.abs(f"sum_{c}") < money(CENT) for c in cols])


def pair_classify(df: DataFrame, keys: Sequence[str] = S.STRICT_KEYS) -> DataFrame:
    """Category of every group of near copies, and whether a pair's totals match its parts."""
    expected = sum((F.col(f"sum_{p}") for p in S.PARTS[1:]), F.col(f"sum_{S.PARTS[0]}"))
    gap = (F.col(f"sum_{S.TOTAL}") - expected).cast("decimal(18,2)")
    opposite = (F.col("n_pos_fare") == 1) & (F.col("n_neg_fare") == 1)
    same = (F.col("n_pos_fare") == 2) | (F.col("n_neg_fare") == 2)
    core, tip, extra = _cancels(*CORE), _cancels(S.TIP), _cancels(*SURCHARGES)
    category = (
        F.when(F.col("n") > 2, MORE_THAN_TWO)
        .when(same, SAME_SIGN)
        .when(opposite & core & tip & extra, MIRROR)
        .when(opposite & core & ~tip & extra, EXCEPT_TIP)
        .when(opposite & core & tip & ~extra, EXCEPT_SURCHARGE)
        .when(opposite & core & ~tip & ~extra, EXCEPT_BOTH)
        .when(opposite & ~core, CORE_DIFFERS)
        .otherwise(OTHER)
    )
    return pair_features(df, keys).withColumns(
        {
            "is_opposite_sign": opposite,
            "is_same_sign": same,
            "core_cancels": core,
            "tip_cancels": tip,
            "surcharges_cancel": extra,
            "total_gap": gap,
            "total_reconciles": F.abs(gap) < money(CENT),
            "category": category,
        }
    )


def pair_category_summary(df: DataFrame) -> DataFrame:
    groups = pair_classify(df).groupBy("category")
    counts = groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("groups"))
    pairs = F.when(F.col("category") != MORE_THAN_TWO, F.col("groups"))
    return counts.select(
        "category", "n_rows", pairs.alias("pairs"), share_of_all("n_rows").alias("pct_rows")
    ).orderBy(F.desc("n_rows"), "category")


def neg_fare_by_category(df: DataFrame) -> DataFrame:
    """Where the negative fares are."""
    return (
        pair_classify(df)
        .groupBy("category")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("n_neg_fare").alias("negative_fares"),
            F.sum("n_zero_fare").alias("zero_fares"),
            F.min("min_fare").cast("double").alias("min_fare"),
            F.max("max_fare").cast("double").alias("max_fare"),
        )
        .orderBy(F.desc("negative_fares"), "category")
    )


def pair_reconciliation(df: DataFrame) -> DataFrame:
    """Per category of pairs: totals that miss their parts, median and largest gap."""
    pairs = pair_classify(df).where(F.col("n") == 2)
    counts = pairs.groupBy("category", "total_gap").agg(F.count("*").alias("pairs_"))
    n, gap = F.col("pairs_"), F.col("total_gap")
    off = F.coalesce(F.sum(F.when(F.abs(gap) >= money(CENT), n)), F.lit(0))
    return (
        counts.groupBy("category")
        .agg(
            F.sum(n).alias("pairs"),
            off.alias("mismatched"),
            share(off, F.sum(n)).alias("pct_mismatched"),
            weighted_median(gap, n).alias("median_gap"),
            F.max(F.abs(gap)).cast("double").alias("max_abs_gap"),
        )
        .orderBy(F.desc("mismatched"), "category")
    )


def pair_examples(df: DataFrame, n: int = 2, keys: Sequence[str] = S.STRICT_KEYS) -> DataFrame:
    """All rows of the first n groups of every category."""
    place = F.row_number().over(W.partitionBy("category").orderBy(GROUP))
    first = pair_classify(df, keys).withColumn("place", place).where(F.col("place") <= n)
    chosen = first.select(*[F.col(k).alias(f"_{k}") for k in keys], GROUP, "category")
    same = both([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    # At most n groups for each of the eight categories.
    return df.join(F.broadcast(chosen), same).select(
        "category", GROUP, S.ID, S.FARE, S.TIP, S.TOLLS, S.CONGESTION, S.AIRPORT, S.CBD, S.TOTAL
    )


def remove_rows(df: DataFrame, ids: DataFrame, key: str = S.ID) -> DataFrame:
    """Drop the rows whose id is in the set."""
    return df.join(ids, key, "left_anti")


def flag_rows(df: DataFrame, ids: DataFrame, name: str, key: str = S.ID) -> DataFrame:
    """Mark the rows whose id is in the set (ids without repeats)."""
    marked = df.join(ids.select(key, F.lit(True).alias(name)), key, "left")
    return marked.withColumn(name, F.coalesce(name, F.lit(False)))
