"""Removal of id sets by blocks of bits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.operators import membership as M
from triplens.sources.shared import pin


@pytest.mark.parametrize("limits", [(-1, 10**9), (10**9, 10**9), (-1, -1)])
def test_every_way_removes_the_same_rows(spark, limits):
    rows = spark.range(30_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias(S.ID), (F.col("id") * 2).alias("x"))
    ids = pin(spark.range(0, 30_000, 3).select(F.col("id").alias(S.ID)).union(spark.sql("SELECT 3L UNION ALL SELECT CAST(NULL AS BIGINT)")))
    left = M.remove_known(rows, ids, S.ID, *limits)
    assert left.columns == rows.columns
    got = sorted(r.x for r in left.collect())
    assert got == sorted(2 * i for i in range(30_000) if i % 1000 == 7 or i % 3)


def test_bits_miss_no_id_and_pass_few_others(spark):
    ids = spark.range(0, 40_000, 2).select(F.col("id").alias(S.ID))
    n = M.blocks_for(20_000)
    held = pin(M.id_blocks(ids, n))
    assert n > 1 and {len(r._words) for r in held.collect()} == {M.WORDS} and held.count() == n
    tested = M.may_be_in(spark.range(40_000).select(F.col("id").alias(S.ID)), held, n)
    known, others = (tested.where(F.col(S.ID) % 2 == k).where("_maybe").count() for k in (0, 1))
    assert known == 20_000 and others < 0.03 * 20_000


def test_an_empty_set_removes_nothing(spark):
    rows = spark.range(100).select(F.col("id").alias(S.ID))
    assert M.remove_known(rows, pin(rows.limit(0)), broadcast_ids=-1).count() == 100
    assert M.remove_known(rows.limit(0), pin(rows), broadcast_ids=-1).count() == 0


def test_only_rows_that_may_match_are_shuffled(spark):
    rows = spark.range(50_000).select(F.col("id").alias(S.ID), F.col("id").alias("wide"))
    ids = pin(spark.range(0, 50_000, 100).select(F.col("id").alias(S.ID)))
    plan = M.remove_known(rows, ids, broadcast_ids=-1)._jdf.queryExecution().executedPlan().toString()
    # One exchange of the rows that may match, one of the ids; the branch of sure rows has none but the blocks' broadcast.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("BroadcastHashJoin") == 2
