"""One group holds well over a third of all rows; results stay whole and equal to the oracles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oracles import ORACLES
from oracles.base import TRIPS
from tests.compare import connect, differences
from triplens import schema as S
from triplens.plans.catalog import QUERIES
from triplens.sources import derived

NAMES = (
    "near_dups_strict_counts", "near_dups_strict", "exact_dup_counts", "pair_category_summary",
    "neg_fare_by_category", "pair_reconciliation", "pair_examples", "ordered_neighbours", "refund_rows",
    "dispute_rows", "clean_trips", "cleaning_report", "negative_by_column_split", "discrepancy_by_payment",
    "discrepancy_overall", "outlier_thresholds", "histogram_total", "top_gaps", "payment_behavior",
    "sample_points", "zone_agg", "kpi_summary",
)


@pytest.fixture(scope="module")
def skewed(spark, trips, folder, tmp_path_factory):
    """The name under which the catalog finds the skewed table, and DuckDB with its SQL."""
    path = str(tmp_path_factory.mktemp("skew") / "trips")
    hot = trips.where(f"{S.ID} = 50").drop(S.ID).crossJoin(spark.range(2000))
    hot = hot.withColumn(S.ID, F.lit(3_000_000_000) + F.col("id") * 3).drop("id")
    trips.unionByName(hot).write.parquet(path)
    derived._stored[(spark.sparkContext.applicationId, "trips", path)] = (path, trips.schema)
    table = f"""WITH t AS (SELECT *,
 (epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 1000000.0::DOUBLE AS secs,
 (epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 1000000.0::DOUBLE / 60.0::DOUBLE AS mins
 FROM read_parquet('{path}/*.parquet'))"""
    con = connect(folder)
    return path, con, {n: ORACLES[n].replace(TRIPS.rstrip(), table) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_hot_group(name, spark, skewed):
    path, con, sql = skewed
    _, bad = differences(QUERIES[name](spark, path), con, sql[name])
    assert not bad, bad[:3]
