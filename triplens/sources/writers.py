"""Writers for the cleaned table, zone aggregates, summaries and whole studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens import schema as S


def write_clean(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by pickup month, so later reads of a period skip the other months.

    Rows are brought together by month first, large months in several tasks, so the number of
    files follows the data and not tasks times months.
    """
    month = F.date_format(S.PICKUP, "yyyy-MM").alias("pickup_month")
    df.select("*", month).hint("rebalance", "pickup_month").write.mode(mode).partitionBy("pickup_month").parquet(path)


def rewrite_months(df: DataFrame, path: str, months: Sequence[str]) -> None:
    """Replace the given pickup months of a cleaned table; its other months are not touched.

    ``df`` has the cleaned trips of these months. Rows of any other month are an error, as they would replace theirs.
    A month that has no rows left keeps no partition.
    """
    month = F.date_format(S.PICKUP, "yyyy-MM")
    found = {r.pickup_month for r in df.select(month.alias("pickup_month")).distinct().collect()}
    if not found <= set(months):
        raise ValueError(f"rows of another month than {', '.join(months)}")
    rows = df.select("*", month.alias("pickup_month")).hint("rebalance", "pickup_month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pickup_month").parquet(path)
    context = df.sparkSession.sparkContext
    for gone in set(months) - found:
        place = context._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/pickup_month={gone}")
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def write_zone_agg(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header. Spark writes the parts; a summary has few rows."""
    df.write.mode(mode).csv(path, header=True)


MANIFEST = "manifest"


def write_tables(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a named set of tables, each a dataset of its own, and last of all the manifest.

    The manifest has each table's name, form, schema and number of rows as written. It is taken
    away before anything is overwritten, so a set whose writing broke off has none and cannot be read.
    """
    folder = folder.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "overwrite":
        files.delete(place, True)
    elif files.exists(place):
        raise ValueError(f"{folder} already holds a set of tables")
    entries = []
    for name, table in tables.items():
        table.write.mode(mode).option("header", True).format(form).save(f"{folder}/{name}")
        written = spark.read.schema(table.schema).option("header", True).format(form).load(f"{folder}/{name}")
        entries.append((name, form, table.schema.json(), written.count()))
    manifest = spark.createDataFrame(entries, "table_name string, form string, schema string, n_rows bigint")
    manifest.coalesce(1).write.json(f"{folder}/{MANIFEST}")


def save_report(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """A study is a named set of tables; each becomes one Parquet dataset."""
    write_tables(tables, folder, "parquet", mode)


def write_summaries(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """The summaries behind figures, each as CSV with a header."""
    write_tables(tables, folder, "csv", mode)
