"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.operators import discrepancy as D
from triplens.operators import duplicates as U
from triplens.operators import rules
from triplens.operators import zones as Z
from triplens.operators.neighbours import LEVELS, ordered_neighbours
from triplens.plans import cleaning as K
from triplens.sources.derived import derive_trips

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("levels", [None, LEVELS])
def test_rows_never_go_to_one_partition(trips, levels):
    """Only the ends of the outermost blocks meet in one task; rows are shuffled by block."""
    lines = plan(ordered_neighbours(trips.select(S.ID, S.PU), [S.PU], levels=levels)).splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert single
    for i in single:
        assert re.search(r"HashAggregate\(keys=\[_block1", lines[i + 1]), lines[i + 1]


def test_filters_and_columns_reach_the_scan(trips):
    (rule,) = [r for r in K.row_rules() if r.step == 3]
    text = plan(trips.where(rule.keep()).select(S.ID))
    assert "GreaterThanOrEqual(tpep_pickup_datetime,2025-01-01T00:00" in text
    assert f"ReadSchema: struct<{S.ID}:bigint,{S.PICKUP}:timestamp_ntz>" in text


def test_many_rules_take_one_scan_and_one_shuffle(trips):
    text = plan(rules.negative_counts(trips))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_medians_shuffle_counts_not_rows(trips):
    text = plan(D.by_payment(D.add_discrepancy(trips)))
    below = text[text.index("Exchange hashpartitioning(payment") :]
    assert "partial_percentile" in text and "partial_count(1)" in below


def test_top_k_per_group_is_cut_before_the_shuffle(trips):
    text = plan(D.modal_values_by_vendor(D.add_discrepancy(trips)))
    assert "WindowGroupLimit" in text


def test_small_id_sets_leave_the_wide_table_unshuffled(trips):
    clean = K.clean_trips(trips)
    text = plan(clean)
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in text
    assert clean.where(F.col(S.ID) < 0).count() == 0


def test_wide_groups_are_made_of_rows_with_repeated_hashes_only(trips):
    text = plan(U.exact_dup_counts(trips))
    wide = text[text.index("Exchange hashpartitioning(VendorID") :]
    assert "LeftSemi" in wide and "Exchange hashpartitioning" not in wide[10:]


def test_zone_sums_read_the_trips_once(trips):
    assert plan(Z.zone_agg(trips)).count("FileScan") == 1


def test_known_sets_are_removed_in_one_join(spark, trips):
    """Refunds and disputes that are known already are one set: the wide rows are tested once, and the result stays."""
    ids = [r[0] for r in K.clean_trips(trips).select(S.ID).orderBy(S.ID).limit(6).collect()]
    kinds = [K.REFUNDS, K.REFUNDS, K.DISPUTES, K.DISPUTES, K.PAIRS]
    sets = spark.createDataFrame([*zip(ids, kinds), (None, K.REFUNDS), (ids[0], K.DISPUTES)], f"{S.ID} bigint, kind string")
    clean = K.clean_trips(trips, sets=sets)
    assert plan(clean).count("LeftAnti") == 1
    assert [r[0] for r in clean.where(F.col(S.ID).isin(ids)).select(S.ID).orderBy(S.ID).collect()] == ids[4:]


def test_derived_money_is_made_by_one_function(spark, folder):
    """Ten decimal products in one projection took more CPU time than one function of all amounts."""
    text = derive_trips(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\* 0\.01\b", text)) <= 1
