"""Outlier cutoffs: quantile based and fixed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import in_long_form, minutes, seconds
from triplens.functions.stats import percentiles, value_counts, weighted_count
from triplens.sources.shared import pin

# Quantiles and interquartile multiples.
QUANTILES = {"p99": 0.99, "p99.9": 0.999, "p99.95": 0.9995, "p99.99": 0.9999}
IQR_MULTIPLES = {"iqr_1.5": 1.5, "iqr_3": 3.0}


def _measures() -> dict[str, Column]:
    """Measure per variable, null where the value takes no part. Duration is in seconds here."""
    distance, amount = F.col(S.DISTANCE), F.col(S.TOTAL)
    return {
        "trip_distance": F.when(distance >= 0, distance),
        "duration_min": F.when(seconds() > 0, seconds()),
        "total_amount": F.when(amount >= 0, amount),
    }


def outlier_thresholds(
    df: DataFrame,
    measures: Mapping[str, Column] | None = None,
    per_unit: Mapping[str, float] | None = None,
) -> DataFrame:
    """(variable, method, cutoff, n_above) for every variable and method.

    One pass counts equal values; cutoffs and the rows above them both come from those pinned
    counts.
    """
    measures = dict(measures or _measures())
    per_unit = {"duration_min": 60.0} if per_unit is None else per_unit
    scale = F.lit(1.0)
    for name, unit in per_unit.items():
        scale = F.when(F.col("variable") == name, F.lit(unit)).otherwise(scale)
    counts = value_counts(df, [], measures).where(F.col("value").isNotNull())
    counts = pin(counts.withColumn("value", F.col("value").cast("double") / scale))

    probs = [0.25, 0.75, *QUANTILES.values()]
    q = percentiles(counts, ["variable"], probs)
    low, high = F.col("q")[0], F.col("q")[1]
    cutoffs = {m: high + F.lit(k) * (high - low) for m, k in IQR_MULTIPLES.items()}
    cutoffs |= {m: F.col("q")[i + 2] for i, m in enumerate(QUANTILES)}
    limits = in_long_form(
        q,
        *[
            {"variable": F.col("variable"), "method": F.lit(m), "cutoff": c}
            for m, c in cutoffs.items()
        ],
    )
    # One row per variable and method: a fixed handful.
    joined = counts.join(F.broadcast(limits), "variable")
    return joined.groupBy("variable", "method", "cutoff").agg(
        weighted_count(F.col("value") > F.col("cutoff"), F.col("n")).alias("n_above")
    )


def domain_thresholds(
    df: DataFrame, limits: Mapping[str, tuple[Column, Sequence[float]]] | None = None
) -> DataFrame:
    """(variable, threshold, n_above, largest) for fixed limits."""
    # Limits in miles, dollars and minutes.
    limits = limits or {
        "trip_distance": (F.col(S.DISTANCE), (100.0, 200.0)),
        "fare_amount": (F.col(S.FARE).cast("double"), (200.0, 500.0)),
        "total_amount": (F.col(S.TOTAL).cast("double"), (200.0, 500.0)),
        "duration_min": (minutes(), (480.0,)),
    }
    row = df.agg(
        *[F.max(c).alias(f"max_{v}") for v, (c, _) in limits.items()],
        *[
            F.count_if(c > t).alias(f"n_{v}_{int(t)}")
            for v, (c, ts) in limits.items()
            for t in ts
        ],
    )
    return in_long_form(
        row,
        *[
            {
                "variable": F.lit(v),
                "threshold": F.lit(t),
                "n_above": F.col(f"n_{v}_{int(t)}"),
                "largest": F.col(f"max_{v}"),
            }
            for v, (_, ts) in limits.items()
            for t in ts
        ],
    )
