"""Overview and null profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.expressions import both, in_long_form, share, share_of_all

NULL_COLUMNS = (S.PASSENGERS, S.RATE, S.FLAG, S.CONGESTION, S.AIRPORT)


def _null_share(col: str):
    return share(F.count_if(F.col(col).isNull()), F.count("*"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """(variable, type, filled): the inventory of columns and how many values each holds."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return in_long_form(
        row,
        *[
            {"variable": F.lit(c), "type": F.lit(t), "filled": F.col(c)}
            for c, t in df.dtypes
        ],
    )


def by_footers(spark: SparkSession, path: str) -> DataFrame:
    """Stored Parquet, read so that counts (and least and greatest numbers and dates) come from the files' footers.

    The data pages are not touched. That holds for aggregates over the whole table without filters; whatever else is
    asked is computed as usual. NaN is a value for a footer, not a missing one. The session of the result is one of its own, in
    which Parquet is read through the interface that passes aggregates down.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def footer_profile(stored: DataFrame) -> DataFrame:
    """(variable, n_rows, null_count, null_pct) of every column of a table read by its footers."""
    row = stored.agg(F.count("*").alias("rows_"), *[F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(stored.columns)])
    empty = [F.col("rows_") - F.col(f"n_{i}") for i in range(len(stored.columns))]
    return in_long_form(
        row,
        *[
            {"variable": F.lit(c), "n_rows": F.col("rows_"), "null_count": empty[i], "null_pct": share(empty[i], F.col("rows_"))}
            for i, c in enumerate(stored.columns)
        ],
    )


def footer_ranges(stored: DataFrame) -> DataFrame:
    """(variable, smallest, largest) of the whole-number and double columns of a table read by its footers."""
    cols = [c for c, t in stored.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    row = stored.agg(*[f(F.col(f"`{c}`")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    return in_long_form(
        row,
        *[{"variable": F.lit(c), "smallest": F.col(f"lo_{i}").cast("double"), "largest": F.col(f"hi_{i}").cast("double")} for i, c in enumerate(cols)],
    )


def freq_table(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    rows = df.where(F.col(col).isNotNull()) if dropna else df
    return rows.groupBy(col).agg(F.count("*").alias("n")).orderBy(col)


def date_range(df: DataFrame, cols: Sequence[str] = (S.PICKUP, S.DROPOFF)) -> DataFrame:
    row = df.agg(
        *[F.min(c).alias(f"min_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in cols]
    )
    return in_long_form(
        row,
        *[
            {
                "variable": F.lit(c),
                "earliest": F.col(f"min_{c}"),
                "latest": F.col(f"max_{c}"),
            }
            for c in cols
        ],
    )


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, counted in one pass over the table."""
    cols = list(cols or df.columns)
    row = df.agg(
        F.count("*").alias("rows_"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    return in_long_form(
        row,
        *[
            {
                "variable": F.lit(c),
                "null_count": F.col(c),
                "null_pct": share(F.col(c), F.col("rows_")),
            }
            for c in cols
        ],
    ).orderBy(F.desc("null_count"), "variable")


def null_share_by(df: DataFrame, col: str = S.PASSENGERS, by: str = S.VENDOR) -> DataFrame:
    """Of all nulls in ``col``, how many fall on each group."""
    counts = df.where(F.col(col).isNull()).groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share_of_all("n"))


def null_rate_by(
    df: DataFrame, cols: Sequence[str] = NULL_COLUMNS, by: str = S.VENDOR
) -> DataFrame:
    """Null rate inside each group, and the group's share of the table."""
    counts = df.groupBy(by).agg(
        F.count("*").alias("trips"), *[_null_share(c).alias(f"null_pct_{c}") for c in cols]
    )
    return counts.withColumn("pct_of_dataset", share_of_all("trips"))


def null_trend(
    df: DataFrame, cols: Sequence[str] = (S.PASSENGERS, S.RATE), by: str = S.MONTH
) -> DataFrame:
    measures = []
    for c in cols:
        measures += [
            F.count_if(F.col(c).isNull()).alias(f"null_{c}"),
            _null_share(c).alias(f"null_pct_{c}"),
        ]
    return df.groupBy(by).agg(F.count("*").alias("trips"), *measures).orderBy(by)


def null_overlap(
    df: DataFrame,
    block: Sequence[str] = S.NULL_BLOCK,
    fee: str = S.AIRPORT,
    passengers: str = S.PASSENGERS,
) -> DataFrame:
    """How far the nulls of several fields fall on the same rows. One row, one pass."""
    core = both([F.col(c).isNull() for c in block])
    no_fee = F.col(fee).isNull()
    no_passengers = F.col(passengers).isNull()
    return df.agg(
        F.count_if(core).alias("core"),
        F.count_if(core & no_fee).alias("core_and_fee"),
        F.count_if(core & no_fee & no_passengers).alias("core_fee_and_passengers"),
        F.count_if(core & ~no_fee).alias("core_with_fee_present"),
        (F.count_if(no_passengers) - F.count_if(core)).alias("passengers_beyond_core"),
    )


def null_block_by(
    df: DataFrame, block: Sequence[str] = S.NULL_BLOCK, by: str = S.VENDOR
) -> DataFrame:
    """Which groups the rows with the whole block missing belong to."""
    rows = df.where(both([F.col(c).isNull() for c in block]))
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("pct", share_of_all("n"))
