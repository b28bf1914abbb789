"""NaN counts as missing, and both ways to percentiles agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.functions.stats import percentiles, value_counts
from triplens.operators import eda, outliers
from triplens.plans import cleaning
from triplens.sources.readers import typed_trips


@pytest.fixture(scope="module")
def pair(trips):
    """The trips with NaN, and with null, as distance of every hundredth row."""
    odd = F.col(S.ID) % 100 == 0
    raw = trips.withColumn(S.DISTANCE, F.when(odd, F.lit(float("nan"))).otherwise(F.col(S.DISTANCE)))
    clean = trips.withColumn(S.DISTANCE, F.when(~odd, F.col(S.DISTANCE)))
    assert raw.where(F.isnan(S.DISTANCE)).count() > 0
    return typed_trips(raw), clean


@pytest.mark.parametrize(
    "run",
    [
        outliers.outlier_thresholds,
        outliers.domain_thresholds,
        eda.kpi_summary,
        lambda df: eda.histogram(df, F.col(S.DISTANCE)),
        eda.sample_points,
        eda.band_matrix,
        lambda df: cleaning.clean_trips(df).select(S.ID, S.DISTANCE),
    ],
)
def test_nan_is_missing(pair, run):
    a, b = (sorted(map(str, run(df).collect())) for df in pair)
    assert a == b and not any("nan" in x.lower() for x in a)


@pytest.mark.parametrize("few", [10**6, 0])
@pytest.mark.parametrize("rows", [[], [("a", 1.0), ("a", 3.0), (None, 5.0), (None, 6.0), ("b", None)]])
def test_percentiles_agree_on_null_groups_and_no_rows(spark, few, rows):
    df = spark.createDataFrame(rows, "g string, value double")
    counts = df.groupBy("g", "value").agg(F.count("*").alias("n"))
    got = {r.g: r.q for r in percentiles(counts, ["g"], [0.5], few).collect()}
    assert got == ({"a": [2.0], None: [5.5]} if rows else {})
    whole = percentiles(df.groupBy("value").agg(F.count("*").alias("n")), [], [0.5], few).collect()
    assert [r.q for r in whole] == ([[4.0]] if rows else [])


def test_value_counts_keep_cents(spark):
    df = spark.createDataFrame([(1.25,), (1.25,), (None,)], "v double")
    assert {(r.value and float(r.value), r.n) for r in value_counts(df, [], {"v": F.col("v")}).collect()} == {(1.25, 2), (None, 1)}
