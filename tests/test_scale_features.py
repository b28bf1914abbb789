"""Sketches, orders by any key, footers, and months that are cleaned anew."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.frames import later, make_trips
from triplens import schema as S
from triplens.operators import neighbours as N
from triplens.operators import outliers as O
from triplens.operators import polygons as G
from triplens.operators import profile as P
from triplens.operators import sketches as X
from triplens.operators import trends as T
from triplens.plans import cleaning as K
from triplens.sources import writers


def test_sketches_of_months_merge_to_those_of_all(spark, trips):
    sketches = X.quantile_sketches(trips).cache()
    assert sketches.select("pickup_month").distinct().count() > 2
    exact = {(r.variable, r.method): r for r in O.outlier_thresholds(trips).collect()}
    found = X.sketched_thresholds(trips, sketches).collect()
    assert len(found) == len(exact)
    totals = {r.variable: r.n for r in X.merged(sketches).collect()}
    for r in found:
        assert abs(r.n_above - exact[r.variable, r.method].n_above) <= 3 * r.rank_error * totals[r.variable] + 2
    assert all(r.within for r in X.rank_check(trips, X.sketched_quantiles(sketches, [0.01, 0.5, 0.99])).collect())


def test_sketches_of_few_and_of_no_values(spark):
    rows = make_trips(spark, {S.DISTANCE: 1.0}, {S.DISTANCE: 3.0}, {S.DISTANCE: None, S.PICKUP: None})
    found = {(r.variable, r.prob): r.value for r in X.sketched_quantiles(X.quantile_sketches(rows), [0.0, 1.0]).collect()}
    assert found["trip_distance", 0.0] == 1.0 and found["trip_distance", 1.0] == 3.0
    assert X.sketched_thresholds(rows, X.quantile_sketches(rows.limit(0))).count() == 0


def test_an_error_beyond_the_stated_one_is_seen(spark, trips):
    wrong = X.sketched_quantiles(X.quantile_sketches(trips), [0.5]).withColumn("value", F.col("value") * 2)
    assert not all(r.within for r in X.rank_check(trips, wrong).collect())


@pytest.mark.parametrize("block_rows", [3, 50, 1 << 20])
def test_neighbours_in_any_order(spark, block_rows):
    """Skewed, repeated and null keys of several types."""
    r = random.Random(block_rows)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, r.choice([None, "a", "a", "a", "a", "b", f"k{r.randrange(9)}"]), None if r.random() < 0.1 else start + dt.timedelta(seconds=r.randrange(40))) for i in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, name string, at timestamp_ntz").repartition(5)
    found = {x.id: (x.prev_id, x.next_id, x.prev_name) for x in N.neighbours_in_order(df, ["id", "name"], ["name", "at", "id"], block_rows).collect()}
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2] is not None, x[2] or start, x[0]))
    for i, x in enumerate(order):
        before, after = order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None
        assert found[x[0]] == (before and before[0], after and after[0], before and before[1])
    assert len(found) == len(rows)


def test_neighbours_in_any_order_need_no_window_over_all_rows(spark, trips):
    text = N.neighbours_in_order(trips.select(S.ID, S.PICKUP), [S.ID], [S.PICKUP, S.ID])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("[_block" in line for line in windows)
    empty = N.neighbours_in_order(trips.select(S.ID, S.PICKUP).limit(0), [S.ID], [S.PICKUP, S.ID])
    assert empty.count() == 0


def test_counts_come_from_footers(spark, trips, tmp_path):
    trips.write.parquet(str(tmp_path / "t"))
    stored = P.by_footers(spark, str(tmp_path / "t"))
    for found in (P.footer_profile(stored), P.footer_ranges(stored)):
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [" in text and "PushedAggregation: []" not in text
    exact = {r.variable: r.null_count for r in P.null_profile(trips).collect()}
    assert {r.variable: r.null_count for r in P.footer_profile(stored).collect()} == exact
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_a_month_cleaned_anew_equals_the_full_run(spark, trips, tmp_path):
    path, sets = str(tmp_path / "clean"), K.removal_sets(trips).cache()
    full = K.clean_trips(trips, sets=sets)
    late = (F.month(S.PICKUP) == 3) & (F.col(S.PU) % 2 == 0)
    writers.write_clean(K.clean_trips(trips.where(~late), sets=sets), path)
    assert spark.read.parquet(path).count() < full.count()
    kept = {f for f in spark.read.parquet(path).where("pickup_month != '2025-03'").inputFiles() if "2025-03" not in f}
    writers.rewrite_months(K.clean_month(trips, "2025-03"), path, ["2025-03"])
    again = spark.read.parquet(path).select(*full.columns)
    assert again.exceptAll(full).count() == full.exceptAll(again).count() == 0
    assert kept <= set(spark.read.parquet(path).inputFiles())


def test_other_months_are_safe(spark, tmp_path):
    path = str(tmp_path / "clean")
    rows = make_trips(spark, {}, {S.PICKUP: later(days=40), S.DROPOFF: later(days=40, minutes=9)})
    writers.write_clean(rows, path)
    with pytest.raises(Exception, match="another month"):
        writers.rewrite_months(rows, path, ["2025-02"])
    assert spark.read.parquet(path).count() == 2
    writers.rewrite_months(rows.limit(0), path, ["2025-02"])
    assert [r.pickup_month for r in spark.read.parquet(path).select(F.col("pickup_month").cast("string")).collect()] == ["2025-03"]


def figures(spark, *shapes):
    rows = spark.createDataFrame(list(enumerate(shapes)), "LocationID int, shape string")
    return {r.LocationID: r for r in G.zone_polygons(rows).collect()}


def test_polygons_of_all_kinds(spark):
    found = figures(
        spark,
        "POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))",
        "polygon((0 0,0 2,4 2,4 0))",
        "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4), (1 1, 3 1, 3 3, 1 3)), ((-10.5 0, -9.5 0, -9.5 1e0, -10.5 1)))",
        "MULTIPOLYGON EMPTY",
        None,
        "POLYGON ((0 0, 1 x, 2 2))",
        "LINESTRING (0 0, 1 1)",
        "POLYGON ((1 1, 2 2, 3 3))",
        "POLYGON ((0 0, 1 0)",
    )
    for i in (0, 1):
        assert (found[i].area, found[i].centroid_x, found[i].centroid_y) == (8.0, 2.0, 1.0)
        assert (found[i].min_x, found[i].max_x, found[i].min_y, found[i].max_y) == (0.0, 4.0, 0.0, 2.0)
    assert (found[0].n_points, found[1].n_points) == (5, 4)
    assert (found[2].n_parts, found[2].n_holes, found[2].area) == (2, 1, 13.0)
    assert abs(found[2].centroid_x - (12 * 2 - 10) / 13) < 1e-12 and found[2].min_x == -10.5
    assert (found[3].n_parts, found[3].area, found[3].centroid_x, found[3].min_x) == (0, 0.0, None, None)
    assert all(found[i].parts is None and found[i].area is None and found[i].n_points is None for i in (4, 5, 6, 8))
    assert found[7].area == 0.0 and found[7].centroid_x is None and found[7].max_y == 3.0


def test_trend_of_a_line_is_the_line(spark):
    rows = spark.range(2000).select((F.col("id") % 97 / 7).alias("x"), (F.col("id") % 97 / 7 * 3 + 2).alias("y"))
    for r in T.local_trend(rows, "x", "y", 0.25, 1.5).collect():
        assert abs(r.fitted - (3 * r.at + 2)) < 1e-4  # measures are kept to six digits
    one = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0), (None, 3.0)], "x double, y double")
    (row,) = T.local_trend(one, "x", "y", 1.0, 2.0).collect()
    assert (row.n, row.fitted) == (2, 6.0)
    assert T.local_trend(one.limit(0), "x", "y", 1.0, 2.0).count() == 0
    with pytest.raises(Exception, match="too many bins"):
        T.local_trend(rows, "x", "y", 0.25, 1.5, max_bins=3).collect()
