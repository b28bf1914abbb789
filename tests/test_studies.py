"""Sets of tables: shared counts, few scans, manifests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.frames import later, make_trips, records
from triplens import schema as S
from triplens.functions.stats import ROWS
from triplens.operators import discrepancy as D
from triplens.operators import durations as C
from triplens.plans import reports
from triplens.sources import readers, writers


@pytest.fixture
def rows(spark):
    return make_trips(
        spark,
        {},
        {S.TOTAL: "20.00", S.PAYMENT: 2},
        {S.TOTAL: "20.00", S.VENDOR: 6},
        {S.TOTAL: "-3.00", S.FARE: "-10.00"},
        {S.TOTAL: None, S.VENDOR: None, S.RATE: None},
        {S.DROPOFF: later(minutes=-5)},
        {S.DROPOFF: later(minutes=-5), S.VENDOR: 1},
        {S.DROPOFF: later()},
        {S.PICKUP: None, S.DROPOFF: None, S.PU: None},
    )


def plain(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_counts_of_groupings_equal_single_counts(spark, rows):
    counts = reports.GroupedCounts(rows, {"payment": [S.PAYMENT], "both": [S.PAYMENT, S.VENDOR], "vendor": [S.VENDOR]}, always=[S.RATE])
    for name, keys in (("payment", [S.PAYMENT]), ("both", [S.PAYMENT, S.VENDOR]), ("vendor", [S.VENDOR])):
        assert plain(counts.part(name)) == plain(rows.groupBy(S.RATE, *keys).agg(F.count("*").alias(ROWS)))


def test_study_tables_equal_those_of_plain_rows(spark, rows):
    study, gaps = reports.discrepancy_study(rows), D.add_discrepancy(rows)
    for name, single in {
        "overall": D.discrepancy_overall(gaps),
        "by_vendor": D.by_vendor(gaps),
        "by_hour": D.by_hour(gaps),
        "rate_changed_pairs": D.rate_changed_pairs(gaps),
        "top_gaps": D.top_gaps(gaps),
        "medium_band": D.medium_band_eras(gaps),
        "modal_values_by_era": D.modal_values_by_era(gaps),
        "by_daypart_zone": D.discrepancy_by_daypart_zone(gaps),
    }.items():
        assert plain(study[name]) == plain(single), name
    durations = reports.duration_study(rows)
    assert plain(durations["negative_examples"]) == plain(C.neg_duration_examples(rows))
    assert plain(durations["issues_by_vendor"]) == plain(C.issues_by_vendor(rows))
    assert plain(durations["negative_headline"]) == plain(C.neg_duration_headline(rows))


def test_studies_of_an_empty_table(spark, rows):
    empty = rows.limit(0)
    assert reports.discrepancy_study(empty)["overall"].first().trips == 0
    assert reports.negative_study(empty)["orphans"].first().orphans == 0
    assert reports.duration_study(empty)["zero_headline"].first().zero == 0


def test_trips_are_scanned_at_most_three_times(spark, rows, tmp_path):
    """One scan for the count, which is stored; the tables may add two."""
    rows.write.parquet(str(tmp_path / "trips"))
    trips = readers.read_trips(spark, str(tmp_path / "trips"))
    for study, most in ((reports.discrepancy_study, 2), (reports.duration_study, 1), (lambda t: reports.negative_study(t, t.select(S.ID).limit(0)), 0)):
        plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in study(trips).values()]
        scans = [p for p in plans if f"{S.PICKUP}#" in p and f"{S.TOTAL}#" in p and "store_and_fwd_flag" in p]
        assert len(scans) <= most


def test_orphans_of_a_study(spark):
    rows = make_trips(spark, {}, {S.PICKUP: later(hours=3), S.FARE: "-7.00"}, {S.PICKUP: later(hours=6)}, {S.PICKUP: later(hours=9), S.FARE: "-9.00", S.PAYMENT: 2})
    study = reports.negative_study(rows)
    (orphans,) = study["orphans"].collect()
    assert orphans.orphans == 2 and float(orphans.median_fare) == -8.0
    assert {k: r["n"] for k, r in records(study["orphans_by_payment"], "payment").items()} == {"1-Credit card": 1, "2-Cash": 1}
    assert records(study["by_column"], "variable")[S.FARE]["orphan"] == 2


def test_tables_are_read_back_as_written(spark, tmp_path):
    a = spark.sql("SELECT 1 AS x, DATE'2025-01-05' AS d, CAST(1.25 AS DECIMAL(12,2)) AS m, 'a,\"b' AS s, CAST(NULL AS STRING) AS e")
    b = spark.range(3)
    for form in ("parquet", "csv"):
        folder = str(tmp_path / form)
        writers.write_tables({"a": a, "b": b}, folder, form)
        found = readers.read_tables(spark, folder)
        assert list(found) == ["a", "b"]
        assert found["a"].collect() == a.collect() and found["a"].dtypes == a.dtypes
        assert sorted(found["b"].collect()) == sorted(b.collect())
        manifest = spark.read.json(f"{folder}/{writers.MANIFEST}")
        assert {r.table_name: r.n_rows for r in manifest.collect()} == {"a": 1, "b": 3}


def test_a_set_that_broke_off_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "set")
    writers.write_tables({"a": spark.range(2)}, folder)
    with pytest.raises(ValueError, match="already"):
        writers.write_tables({"a": spark.range(2)}, folder)
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        writers.write_tables({"a": spark.range(5), "b": broken}, folder, mode="overwrite")
    with pytest.raises(ValueError, match="manifest"):
        readers.read_tables(spark, folder)
    writers.write_tables({"a": spark.range(5)}, folder, mode="overwrite")
    assert readers.read_tables(spark, folder)["a"].count() == 5
