"""Readers for the trip table, the zone tables and saved summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplens import schema as S
from triplens.sources.writers import MANIFEST

ZONE_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)


def typed_trips(df: DataFrame) -> DataFrame:
    """Cast to the trip schema, money to exact decimals; complain about missing columns.

    NaN counts as missing: Spark would sort it above every number and pass it through ``>=``.
    """
    missing = [c for c in S.COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"trip table lacks columns: {', '.join(missing)}")
    floating = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}

    def known(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c)) if c in floating else F.col(c)

    return df.select(
        *[known(c).cast(t).alias(c) for c, t in S.COLUMNS.items()],
        *[c for c in df.columns if c not in S.COLUMNS],
    )


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return typed_trips(spark.read.parquet(path))


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zone dimension from a quoted CSV with a header. The text "N/A" stays text."""
    return spark.read.schema(ZONE_SCHEMA).csv(path, header=True, quote='"', escape='"')


def read_zone_shapes(
    spark: SparkSession,
    path: str,
    id_column: str = "Location ID",
    shape_column: str = "Shape Geometry",
) -> DataFrame:
    """(LocationID, shape) from a CSV whose polygon text may span lines. The shape stays text."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(
        F.col(f"`{id_column}`").cast("int").alias("LocationID"),
        F.col(f"`{shape_column}`").alias("shape"),
    )


def read_summary(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A set of tables as ``write_tables`` has written it, by name; a set without manifest was not written to its end."""
    folder = folder.rstrip("/")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"{folder} has no manifest: its tables were not all written")
    entries = spark.read.schema("table_name string, form string, schema string, n_rows bigint").json(f"{folder}/{MANIFEST}").collect()
    return {
        e.table_name: spark.read.schema(T.StructType.fromJson(json.loads(e.schema))).option("header", True).format(e.form).load(f"{folder}/{e.table_name}")
        for e in entries
    }
