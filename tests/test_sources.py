from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.frames import make_trips
from triplens import schema as S
from triplens.operators import eda
from triplens.plans import reports
from triplens.sources import readers, shared, writers

LOOKUP = '''"LocationID","Borough","Zone","service_zone"
1,"North","Harbour, East","A"
56,"South","Mill","B"
57,"South","Mill","B"
264,"Unknown","N/A","N/A"
265,"N/A","Elsewhere","N/A"
'''.replace("\n", "\r\n")

SHAPES = '''"Location ID","Shape Geometry","Other"
7,"MULTIPOLYGON (((1 2,
3 4)))","a ""quoted"" name"
8,"MULTIPOLYGON (((5 6, 7 8)))","b"
'''


def test_lookup_keeps_na_as_text(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text(LOOKUP, newline="")
    rows = {r["LocationID"]: r for r in readers.read_zone_lookup(spark, str(path)).collect()}
    assert len(rows) == 5
    assert rows[264]["Zone"] == "N/A" and rows[265]["Borough"] == "N/A"
    assert rows[1]["Zone"] == "Harbour, East" and rows[56]["service_zone"] == "B"


def test_shapes_may_span_lines(spark, tmp_path):
    path = tmp_path / "shapes.csv"
    path.write_text(SHAPES)
    rows = dict(readers.read_zone_shapes(spark, str(path)).collect())
    assert set(rows) == {7, 8} and rows[7] == "MULTIPOLYGON (((1 2,\n3 4)))"


def test_money_becomes_exact_and_missing_columns_are_named(spark, tmp_path):
    df = make_trips(spark, {S.TIP: "0.10"}).withColumn(S.TIP, F.col(S.TIP).cast("double"))
    path = str(tmp_path / "t")
    df.write.parquet(path)
    assert dict(readers.read_trips(spark, path).dtypes) == dict(make_trips(spark, {}).dtypes)
    with pytest.raises(ValueError, match="trip_id, tip_amount"):
        readers.typed_trips(df.drop(S.ID, S.TIP))


def test_clean_table_is_partitioned_by_month(spark, tmp_path):
    df = make_trips(spark, {}, {S.PICKUP: make_trips(spark, {}).first()[S.PICKUP].replace(month=3)})
    path = str(tmp_path / "clean")
    writers.write_clean(df, path)
    months = {d for d in os.listdir(path) if d.startswith("pickup_month=")}
    assert months == {"pickup_month=2025-02", "pickup_month=2025-03"}
    back = spark.read.parquet(path).where("pickup_month = '2025-03'")
    assert "PartitionFilters: [isnotnull(pickup_month" in back._jdf.queryExecution().toString()
    assert back.count() == 1


def test_summary_round_trip(spark, tmp_path):
    summary = eda.kpi_summary(make_trips(spark, {}, {S.TIP: "3.33"}))
    path = str(tmp_path / "kpi")
    writers.write_summary(summary, path)
    assert readers.read_summary(spark, path, summary.schema).collect() == summary.collect()


@pytest.mark.parametrize("study", ["discrepancy_study", "negative_study", "duration_study"])
def test_reports_are_saved_table_by_table(spark, trips, tmp_path, study):
    tables = getattr(reports, study)(trips)
    writers.save_report(tables, str(tmp_path / study))
    for name, table in tables.items():
        assert spark.read.parquet(str(tmp_path / study / name)).columns == table.columns


def test_small_sets_are_broadcast_and_large_ones_not(spark):
    ids = shared.pin(spark.range(100))
    plan = spark.range(10).join(shared.broadcast_if_small(ids), "id")._jdf.queryExecution()
    assert "ResolvedHint (strategy=broadcast)" in plan.analyzed().toString()
    plan = spark.range(10).join(shared.broadcast_if_small(ids, limit=10), "id")._jdf.queryExecution()
    assert "broadcast" not in plan.analyzed().toString()
