"""Order statistics that stay spread out.

``percentile`` on raw rows sends every task's whole value map to one reducer. Here equal
values are first counted, by (group, value), which combines on the map side and spreads
over all reducers; only then are the counted values merged per group. What a group holds
is its number of different values, not its number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens.functions.expressions import SECONDS_TYPE, both, either
from triplens.sources.shared import shared_folder

# Up to this many counted values one reducer may merge them in memory.
FEW_VALUES = 1_000_000


# The column of counted rows that says how many rows each stands for.
ROWS = "_rows"


def counted(df: DataFrame) -> list[str]:
    """The column of counts, if the rows are counted ones."""
    return [ROWS] if ROWS in df.columns else []


def how_many(df: DataFrame, test: Column | None = None) -> Column:
    """How many rows there are (for which ``test`` holds), of plain or of counted rows."""
    if not counted(df):
        return F.count("*") if test is None else F.count_if(test)
    n = F.col(ROWS)
    return F.coalesce(F.sum(n if test is None else F.when(test, n)), F.lit(0))


def value_counts(df: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(by.., variable, value, n) for several measures in one pass; null values are counted too."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("variable"), col.cast(SECONDS_TYPE).alias("value"))
            for name, col in values.items()
        ]
    )
    return (
        df.select(*by, F.inline(pairs)).groupBy(*by, "variable", "value").agg(F.count("*").alias("n"))
    )


def weighted_percentile(value: Column, q: float | Sequence[float], n: Column) -> Column:
    """Exact percentile(s) with linear interpolation over (value, how often)."""
    probs = F.lit(q) if isinstance(q, float) else F.array(*[F.lit(p) for p in q])
    return F.percentile(value, probs, n)


def weighted_median(value: Column, n: Column) -> Column:
    return weighted_percentile(value, 0.5, n)


def weighted_mean(value: Column, n: Column) -> Column:
    used = F.when(value.isNotNull(), n)
    return F.try_divide(F.sum(value * n).cast("double"), F.sum(used).cast("double"))


def weighted_count(condition: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))


def binned_percentiles(
    counts: DataFrame, by: Sequence[str], probs: Sequence[float], width: float = 1.0
) -> DataFrame:
    """(by.., q) with exact percentiles of (by.., value, n) for measures with very many values.

    Counts per bin tell in which bins the wanted ranks lie; only those bins are then ordered
    by value. No task holds more than the bins of a group or the values of a bin, and both
    are streamed in order, not kept in memory. A null group is a group; no values give no row.
    """
    rows = counts.where(F.col("value").isNotNull()).select(
        *by, F.col("value").cast("double").alias("value"), "n"
    )
    rows = rows.withColumn("bin", F.floor(F.col("value") / F.lit(width)))
    sizes = rows.groupBy(*by, "bin").agg(F.sum("n").alias("size"))
    running = F.sum("size").over(W.partitionBy(*by).orderBy("bin"))
    whole = F.sum("size").over(W.partitionBy(*by))
    bins = sizes.select(*by, "bin", "size", running.alias("until"), whole.alias("whole"))

    places = [(F.col("whole") - 1).cast("double") * F.lit(p) for p in probs]
    wanted = either(
        [
            (F.floor(at) < F.col("until")) & (F.ceil(at) >= F.col("until") - F.col("size"))
            for at in places
        ]
    )
    named = bins.where(wanted).select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("bin").alias("_bin"), "size", "until", "whole"
    )
    same = both([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "bin"]])
    inside = rows.join(named, same)
    up_to = F.sum("n").over(W.partitionBy(*by, "bin").orderBy("value"))
    ranked = inside.withColumn("last", F.col("until") - F.col("size") + up_to - 1)

    def value_at(rank: Column) -> Column:
        here = (rank <= F.col("last")) & (rank > F.col("last") - F.col("n"))
        return F.max(F.when(here, F.col("value")))

    def interpolated(at: Column) -> Column:
        low, high = F.floor(at), F.ceil(at)
        below, above = F.max(high - at), F.max(at - low)
        return F.when(
            value_at(low) == value_at(high), value_at(low)
        ).otherwise(below * value_at(low) + above * value_at(high))

    found = ranked.groupBy(*by).agg(F.array(*[interpolated(at) for at in places]).alias("q"))
    return found.where(F.col("q")[0].isNotNull())


def percentiles(
    pinned_counts: DataFrame, by: Sequence[str], probs: Sequence[float], few: int = FEW_VALUES
) -> DataFrame:
    """(by.., q) from pinned counts: merged at once if counted to be few, else bin by bin."""
    known = shared_folder(pinned_counts.sparkSession) is not None
    if known and pinned_counts.count() <= few:
        q = weighted_percentile(F.col("value").cast("double"), list(probs), F.col("n"))
        found = pinned_counts.groupBy(*by).agg(q.alias("q"))
        return found.where(F.col("q").isNotNull())
    return binned_percentiles(pinned_counts, by, probs)
