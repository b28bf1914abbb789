"""A smooth trend of one measure over another, from sums per bin.

A local straight line is fitted at the middle of every bin, with tricube weights that fall to zero at the bandwidth. All
that a fit needs of the rows is their number and five sums per bin: these combine on the map side, and the
fits read at most ``max_bins`` bins, whatever the number of rows. Rows of one bin share a weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens.functions.expressions import exact

MAX_BINS = 2000


def bin_sums(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(bin, n, sx, sy, sxx, sxy) of the rows that have both measures."""
    rows = df.select(exact(x).alias("x"), exact(y).alias("y")).where("x is not null and y is not null")
    place = F.floor(F.col("x").cast("double") / F.lit(width)).alias("bin")
    squares = {"sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}
    sums = {"sx": F.col("x"), "sy": F.col("y")} | {k: v.cast("decimal(28,6)") for k, v in squares.items()}
    return rows.groupBy(place).agg(F.count("*").alias("n"), *[F.sum(v).cast("double").alias(k) for k, v in sums.items()])


def local_trend(df: DataFrame, x: str, y: str, width: float, bandwidth: float, max_bins: int = MAX_BINS) -> DataFrame:
    """(bin, n, at, fitted): the local line's value at the middle of every bin that has rows.

    ``fitted`` is the local mean where the rows near have one x only. More bins than ``max_bins`` are an error: the
    width does not suit the measure.
    """
    every = bin_sums(df, x, y, width).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "sx", "sy", "sxx", "sxy"))).alias("b"))
    few = F.assert_true(F.size("b") <= max_bins, F.lit("too many bins"))
    every = every.where(few.isNull())

    def fit(own: Column) -> Column:
        at = (own.bin + 0.5) * F.lit(width)

        def weight(b: Column) -> Column:
            u = F.least(F.abs((b.bin + 0.5) * F.lit(width) - at) / F.lit(bandwidth), F.lit(1.0))
            return F.pow(1 - u * u * u, F.lit(3.0))

        names = ("n", "sx", "sy", "sxx", "sxy")
        zero = F.struct(*[F.lit(0.0).alias(k) for k in names])
        s = F.aggregate("b", zero, lambda a, b: F.struct(*[(a[k] + weight(b) * b[k]).alias(k) for k in names]))
        return F.struct(own.bin.alias("bin"), own.n.alias("n"), at.alias("at"), s.alias("s"))

    fits = every.select(F.inline(F.transform("b", fit)))
    s = F.col("s")
    spread = s.sxx - s.sx * s.sx / s.n
    slope = F.when(spread > 1e-9 * F.greatest(s.sxx, F.lit(1e-300)), (s.sxy - s.sx * s.sy / s.n) / spread).otherwise(0.0)
    return fits.select("bin", "n", "at", (s.sy / s.n + slope * (F.col("at") - s.sx / s.n)).alias("fitted"))
