"""Quantiles from mergeable sketches, for tables too large to count every value.

A pass over the trips makes one KLL sketch per month and variable. The sketches are small and are stored; later
months only add theirs, and a reader merges them, for all months or some, without the trips. A
sketch knows the rank of a value to within ``rank_error(k)`` of the number of values, whatever the data are like; exact
percentiles (``outliers.outlier_thresholds``) stay the default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import in_long_form
from triplens.operators.outliers import IQR_MULTIPLES, QUANTILES, _measures

K = 4096
MINUTES = {"duration_min": 60.0}


def rank_error(k: int = K) -> float:
    """Twice the error in rank that a KLL sketch keeps with 99 % confidence: in practice a bound."""
    return 2 * 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, measures: Mapping[str, Column] | None = None, k: int = K) -> DataFrame:
    """(pickup_month, variable, n, sketch) in one pass; a variable without values in a month has no row."""
    measures = dict(measures or _measures())
    month = F.date_format(S.PICKUP, "yyyy-MM").alias("pickup_month")
    columns = [(F.col(m).cast("double") / F.lit(MINUTES.get(m, 1.0))).alias(m) for m in measures]
    rows = df.select(month, *[c.alias(m) for m, c in measures.items()]).select("pickup_month", *columns)
    found = rows.groupBy("pickup_month").agg(
        *[F.count(m).alias(f"n_{m}") for m in measures], *[F.kll_sketch_agg_double(m, k).alias(f"s_{m}") for m in measures]
    )
    records = [{"pickup_month": F.col("pickup_month"), "variable": F.lit(m), "n": F.col(f"n_{m}"), "sketch": F.col(f"s_{m}")} for m in measures]
    return in_long_form(found, *records).where("n > 0")


def merged(sketches: DataFrame, k: int = K) -> DataFrame:
    """(variable, n, sketch) over all months that the sketches are given for."""
    return sketches.groupBy("variable").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], k: int = K) -> DataFrame:
    """(variable, n, prob, value)."""
    records = [{"variable": F.col("variable"), "n": F.col("n"), "prob": F.lit(p), "value": F.kll_sketch_get_quantile_double("sketch", F.lit(p))} for p in probs]
    return in_long_form(merged(sketches, k), *records)


def sketched_thresholds(df: DataFrame, sketches: DataFrame, k: int = K, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """(variable, method, cutoff, n_above, rank_error): as ``outlier_thresholds``, with cutoffs from the sketches.

    How many trips lie above a cutoff is counted exactly, in one scan that keeps nothing but counts.
    """
    low, high = (F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in (0.25, 0.75))
    cutoffs = {m: high + F.lit(x) * (high - low) for m, x in IQR_MULTIPLES.items()}
    cutoffs |= {m: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for m, p in QUANTILES.items()}
    limits = in_long_form(merged(sketches, k), *[{"variable": F.col("variable"), "method": F.lit(m), "cutoff": c} for m, c in cutoffs.items()])
    rows = _long(df, measures)
    # A fixed handful of limits.
    above = rows.join(F.broadcast(limits), "variable").groupBy("variable", "method", "cutoff")
    return above.agg(F.count_if(F.col("x") > F.col("cutoff")).alias("n_above")).withColumn("rank_error", F.lit(rank_error(k)))


def _long(df: DataFrame, measures: Mapping[str, Column] | None) -> DataFrame:
    values = [F.struct(F.lit(m).alias("variable"), (c.cast("double") / F.lit(MINUTES.get(m, 1.0))).alias("x")) for m, c in dict(measures or _measures()).items()]
    return df.select(F.inline(F.array(*values))).where(F.col("x").isNotNull())


def rank_check(df: DataFrame, quantiles: DataFrame, measures: Mapping[str, Column] | None = None, k: int = K) -> DataFrame:
    """(variable, prob, n, within): whether the true ranks of the given quantiles are within the stated error.

    ``quantiles`` has a fixed handful of rows, which are looked up for every trip in one scan.
    """
    probe = quantiles.groupBy("variable").agg(F.collect_list(F.struct("prob", "value")).alias("probes"))
    rows = _long(df, measures).groupBy("variable", "x").agg(F.count("*").alias("n"))
    found = rows.join(F.broadcast(probe), "variable").select("variable", "x", "n", F.inline("probes"))
    ranks = found.groupBy("variable", "prob").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("x") < F.col("value"), F.col("n"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("x") <= F.col("value"), F.col("n"))), F.lit(0)).alias("upto"),
    )
    # One value may stand for many equal ones: its rank is an interval.
    slack = F.lit(rank_error(k)) * F.col("n") + 1
    at = F.col("prob") * F.col("n")
    return ranks.select("variable", "prob", "n", ((F.col("below") - slack <= at) & (at <= F.col("upto") + slack)).alias("within"))
