"""Tiny hand-made trip tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from triplens import schema as S

NOON = dt.datetime(2025, 2, 1, 12, 0, 0)

# A plain trip that passes every check.
PLAIN = {
    S.VENDOR: 2,
    S.PICKUP: NOON,
    S.DROPOFF: NOON + dt.timedelta(minutes=10),
    S.PASSENGERS: 1,
    S.DISTANCE: 2.0,
    S.RATE: 1,
    S.FLAG: "N",
    S.PU: 100,
    S.DO: 101,
    S.PAYMENT: 1,
    S.FARE: "10.00",
    S.EXTRA: "0.00",
    S.MTA: "0.50",
    S.TIP: "2.00",
    S.TOLLS: "0.00",
    S.IMPROVEMENT: "1.00",
    S.CONGESTION: "2.50",
    S.AIRPORT: "0.00",
    S.CBD: "0.75",
    S.MONTH: "2025-02",
}
SCHEMA = T.StructType([T.StructField(n, t) for n, t in S.COLUMNS.items()])


def make_trips(spark: SparkSession, *changes: dict) -> DataFrame:
    """One row per dict of changes to the plain trip. Ids count up; totals add up if not given."""
    rows = []
    for i, change in enumerate(changes):
        row = {S.ID: i, **PLAIN, **change}
        for c in S.PARTS:
            row[c] = None if row[c] is None else Decimal(row[c])
        if S.TOTAL in row:
            row[S.TOTAL] = None if row[S.TOTAL] is None else Decimal(row[S.TOTAL])
        else:
            row[S.TOTAL] = sum((row[c] or Decimal(0) for c in S.PARTS), Decimal(0))
        rows.append(tuple(row[c] for c in S.COLUMNS))
    return spark.createDataFrame(rows, SCHEMA)


def later(**kw) -> dt.datetime:
    return NOON + dt.timedelta(**kw)


def records(df: DataFrame, *by: str) -> dict:
    """Rows as dicts, keyed by the given columns."""
    out = {}
    for r in df.collect():
        key = tuple(r[b] for b in by)
        out[key[0] if len(by) == 1 else key] = r.asDict()
    return out
