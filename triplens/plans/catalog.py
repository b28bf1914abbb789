"""Every operator as a named query over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplens import schema as S
from triplens.functions.expressions import seconds
from triplens.operators import discrepancy as D
from triplens.operators import duplicates as U
from triplens.operators import durations as C
from triplens.operators import eda as E
from triplens.operators import membership as M
from triplens.operators import neighbours as N
from triplens.operators import outliers as O
from triplens.operators import polygons as G
from triplens.operators import profile as P
from triplens.operators import refunds as R
from triplens.operators import rules as Q
from triplens.operators import sketches as X
from triplens.operators import trends
from triplens.operators import zones as Z
from triplens.plans import cleaning as K
from triplens.plans import reports, summaries
from triplens.sources import readers, writers
from triplens.sources.derived import stored, trips, zones
from triplens.sources.shared import new_path, pin

Query = Callable[[SparkSession, str], DataFrame]


def with_doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that are compared across engines."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def with_rounding(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles whose last bits depend on the order of addition, cut to comparable digits."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _on(prepare: Callable[[DataFrame], DataFrame], fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: with_doubles(fn(prepare(trips(spark, folder))))


def _raw(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on(lambda df: df, fn)


def _rounded(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: with_rounding(with_doubles(fn(trips(spark, folder))))


_gaps = partial(_on, D.add_discrepancy)


def removal_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of refunds, disputes and refund pairs, stored on first use: neighbours are sought once."""
    return stored(
        spark,
        "removals",
        folder,
        lambda: K.removal_sets(trips(spark, folder)),
        lambda df, path: df.write.parquet(path),
    )


def _flagged(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ids = K.of_kind(removal_sets(spark, folder), K.PAIRS)
        return with_doubles(fn(R.refund_flag(trips(spark, folder), ids=ids)))

    return run


def marked(spark: SparkSession, folder: str) -> DataFrame:
    return K.with_failed_step(trips(spark, folder), sets=removal_sets(spark, folder))


def _marked(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: with_doubles(fn(marked(spark, folder)))


def _clean_now(spark: SparkSession, folder: str) -> DataFrame:
    return K.clean_trips(trips(spark, folder), sets=removal_sets(spark, folder))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned table that dashboards read, stored by month on first use."""
    return stored(spark, "clean", folder, lambda: _clean_now(spark, folder), writers.write_clean)


def _clean(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: with_doubles(fn(cleaned(spark, folder)))


# --- sources and sinks: written to the shared folder and read back


def _round_trip_clean(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "clean")
    writers.write_clean(_clean_now(spark, folder), path)
    return with_doubles(spark.read.parquet(path)).withColumn(
        "pickup_month", F.col("pickup_month").cast("string")
    )


def _round_trip_trips(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "trips")
    with_doubles(trips(spark, folder)).write.parquet(path)
    return with_doubles(readers.read_trips(spark, path))


def _round_trip_lookup(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "zones")
    zones(spark, folder, trips(spark, folder)).write.csv(path, header=True, quoteAll=True)
    return readers.read_zone_lookup(spark, path)


def _round_trip_shapes(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "shapes")
    box = F.format_string(
        "MULTIPOLYGON (((%d 0, %d 1,\n%d 1, %d 0)))", *[F.col("LocationID")] * 4
    )
    table = zones(spark, folder, trips(spark, folder)).select(
        F.col("LocationID").alias("Location ID"), box.alias("Shape Geometry"), "Borough"
    )
    table.write.csv(path, header=True, quoteAll=True)
    return readers.read_zone_shapes(spark, path)


def _polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of shapes with a hole and a second part, written with line breaks and read back."""
    path, i = new_path(spark, "shapes"), F.col("LocationID")
    shape = F.format_string(
        "MULTIPOLYGON (((%d 0, %d 0,\n%d 10, %d 10, %d 0), (%d 2, %d 5, %d 5.0, %d 2)),\n((%d 0, %d 0, %d 4)))",
        i, i + 10, i + 10, i, i, i + 2, i + 2, i + 4, i + 4, i + 20, i + 26, i + 20,
    )
    table = zones(spark, folder, trips(spark, folder)).select(i.alias("Location ID"), shape.alias("Shape Geometry"))
    table.write.csv(path, header=True, quoteAll=True)
    return with_rounding(G.zone_polygons(readers.read_zone_shapes(spark, path)).drop("parts"), 6)


def _round_trip_zone_agg(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "zone-agg")
    writers.write_zone_agg(Z.zone_agg(cleaned(spark, folder)), path)
    return spark.read.parquet(path)


def _round_trip_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = E.kpi_summary(trips(spark, folder))
    path = new_path(spark, "summary")
    writers.write_summary(summary, path)
    return readers.read_summary(spark, path, summary.schema)


def _saved_report(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of the tables of a saved study."""
    tables = reports.duration_study(trips(spark, folder))
    path = new_path(spark, "report")
    writers.save_report(tables, path)
    sizes = [
        spark.read.parquet(f"{path}/{name}").agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows")
        )
        for name in tables
    ]
    out = sizes[0]
    for size in sizes[1:]:
        out = out.unionByName(size)
    return out


def _study(build: Callable[[SparkSession, str], dict[str, DataFrame]], write: Callable = writers.save_report) -> Query:
    """The cells of all tables of a set that was written and read back."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_path(spark, "tables")
        write(build(spark, folder), path)
        return reports.all_cells(readers.read_tables(spark, path))

    return run


def _discrepancy_study(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = reports.discrepancy_study(trips(spark, folder))
    return {**tables, "overall": with_rounding(tables["overall"])}


def _negative_study(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return reports.negative_study(trips(spark, folder), K.of_kind(removal_sets(spark, folder), K.PAIRS))


def _recleaned(spark: SparkSession, folder: str) -> DataFrame:
    """A cleaned table in which one month was written from incomplete trips, after that month was written anew."""
    raw, sets, path, month = trips(spark, folder), removal_sets(spark, folder), new_path(spark, "months"), "2025-02"
    late = (F.date_format(S.PICKUP, "yyyy-MM") == month) & (F.col(S.VENDOR) == 2)
    writers.write_clean(K.clean_trips(raw.where(~late), sets=sets), path)
    writers.rewrite_months(K.clean_month(raw, month, sets), path, [month])
    return with_doubles(spark.read.parquet(path)).withColumn("pickup_month", F.col("pickup_month").cast("string"))


def _footers(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_path(spark, "footers")
        with_doubles(trips(spark, folder)).write.parquet(path)
        return fn(P.by_footers(spark, path))

    return run


def _sketched(df: DataFrame) -> DataFrame:
    """Whether the quantiles of stored sketches keep their stated error."""
    found = X.sketched_quantiles(pin(X.quantile_sketches(df)), [0.25, 0.5, 0.75, *O.QUANTILES.values()])
    return X.rank_check(df, found)


# --- operators that need more than one table


def _ordered_neighbours(df: DataFrame) -> DataFrame:
    return N.ordered_neighbours(df.select(S.ID, S.PICKUP, S.PU), [S.PICKUP, S.PU])


def _remove_refunds(df: DataFrame) -> DataFrame:
    return K.step_refunds(df)[1].select(S.ID, S.PICKUP, S.TOTAL)


def _remove_tested(df: DataFrame) -> DataFrame:
    """Refunds go by the blocks of bits, as they do beyond a million ids."""
    return M.remove_known(df, N.refund_rows(df), broadcast_ids=-1).select(S.ID, S.PICKUP, S.TOTAL)


def _remove_disputes(df: DataFrame) -> DataFrame:
    return K.step_disputes(K.step_refunds(df)[1])[1].select(S.ID, S.PICKUP, S.TOTAL)


def _revenue(spark: SparkSession, folder: str) -> DataFrame:
    raw = trips(spark, folder)
    return K.revenue_by_vendor(raw, cleaned(spark, folder))


def _zone_groups(spark: SparkSession, folder: str) -> DataFrame:
    raw = trips(spark, folder)
    return Z.zone_revenue_groups(zones(spark, folder, raw), Z.zone_revenue(cleaned(spark, folder)))


def _zone_view(zone_type: str, metric: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw = trips(spark, folder)
        agg = Z.zone_agg(cleaned(spark, folder))
        view = Z.zone_view(zones(spark, folder, raw), agg, zone_type, metric)
        return view.withColumn("display_value", F.round("display_value", 9))

    return run


def _step_keep(step: int) -> Callable[[DataFrame], DataFrame]:
    """One row filter of the cleaning, applied alone."""

    def run(df: DataFrame) -> DataFrame:
        (rule,) = [r for r in K.row_rules() if r.step == step]
        return df.where(rule.keep()).select(S.ID, S.VENDOR, S.PICKUP, S.FARE, S.TOTAL)

    return run


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_trips": _round_trip_trips,
    "read_zone_lookup": _round_trip_lookup,
    "read_zone_shapes": _round_trip_shapes,
    "write_clean": _round_trip_clean,
    "zone_polygons": _polygons,
    "rewrite_month": _recleaned,
    "write_zone_agg": _round_trip_zone_agg,
    "write_read_summary": _round_trip_summary,
    "save_report": _saved_report,
    "save_discrepancy_study": _study(_discrepancy_study),
    "save_negative_study": _study(_negative_study),
    "save_duration_study": _study(lambda spark, folder: reports.duration_study(trips(spark, folder))),
    "write_read_summaries": _study(lambda spark, folder: summaries.summaries(cleaned(spark, folder)), writers.write_summaries),
    # profile
    "table_shape": _raw(P.table_shape),
    "column_types": _raw(P.column_types),
    "freq_table_vendor": _raw(partial(P.freq_table, col=S.VENDOR)),
    "freq_table_rate": _raw(partial(P.freq_table, col=S.RATE)),
    "freq_table_month": _raw(partial(P.freq_table, col=S.MONTH, dropna=True)),
    "freq_table_rate_filled": _raw(partial(P.freq_table, col=S.RATE, dropna=True)),
    "date_range": _raw(P.date_range),
    "null_profile": _raw(P.null_profile),
    "null_share_by": _raw(P.null_share_by),
    "null_rate_by": _raw(P.null_rate_by),
    "null_rate_by_two": _raw(partial(P.null_rate_by, cols=(S.PASSENGERS, S.RATE))),
    "null_trend": _raw(P.null_trend),
    "footer_profile": _footers(P.footer_profile),
    "footer_ranges": _footers(P.footer_ranges),
    "null_overlap": _raw(P.null_overlap),
    "null_block_by": _raw(P.null_block_by),
    # duplicates
    "exact_dups": _raw(U.exact_dups),
    "exact_dup_counts": _raw(U.exact_dup_counts),
    "full_row_dup_counts": _raw(partial(U.exact_dup_counts, exclude=())),
    "repeated_ids": _raw(U.repeated_ids),
    "near_dups_simple": _raw(partial(U.dup_rows, keys=S.SIMPLE_KEYS)),
    "near_dups_simple_counts": _raw(partial(U.dup_counts, keys=S.SIMPLE_KEYS)),
    "near_dups_strict": _raw(partial(U.dup_rows, keys=S.STRICT_KEYS)),
    "near_dups_strict_counts": _raw(partial(U.dup_counts, keys=S.STRICT_KEYS)),
    "dup_group_id": _raw(lambda df: U.dup_groups(df, S.STRICT_KEYS).select(U.GROUP, "n")),
    "pair_features": _raw(lambda df: U.pair_features(df).drop(*S.STRICT_KEYS)),
    "pair_classify": _raw(
        lambda df: U.pair_classify(df).select(
            U.GROUP, "n", "is_opposite_sign", "is_same_sign", "core_cancels", "tip_cancels",
            "surcharges_cancel", "total_gap", "total_reconciles", "category",
        )
    ),
    "pair_category_summary": _raw(U.pair_category_summary),
    "neg_fare_by_category": _raw(U.neg_fare_by_category),
    "pair_reconciliation": _raw(U.pair_reconciliation),
    "pair_examples": _raw(U.pair_examples),
    "ordered_neighbours": _raw(_ordered_neighbours),
    "neighbours_in_order": _raw(
        lambda df: N.neighbours_in_order(df.select(S.ID, S.PICKUP, S.PASSENGERS, S.TOTAL), [S.ID, S.TOTAL], [S.PASSENGERS, S.PICKUP, S.ID])
    ),
    "refund_rows": _raw(N.refund_rows),
    "dispute_rows": _raw(N.dispute_rows),
    "remove_rows": _raw(_remove_refunds),
    "remove_rows_tested": _raw(_remove_tested),
    "refund_flag": _flagged(lambda df: df.select(S.ID, R.NEGATIVE, R.REFUND)),
    # rules
    "rule_counts": _raw(
        lambda df: Q.rule_counts(
            df, {"long": seconds() > 3600, "tipped": F.col(S.TIP) > 0, "no_rate": F.col(S.RATE).isNull()}
        )
    ),
    "ts_window_counts": _raw(Q.ts_window_counts),
    "duration_counts": _raw(Q.duration_counts),
    "zero_duration_freq": _raw(Q.zero_duration_freq),
    "mix_compare_payment": _raw(Q.mix_compare),
    "mix_compare_vendor": _raw(partial(Q.mix_compare, col=S.VENDOR)),
    "distance_duration_counts": _raw(Q.distance_duration_counts),
    "code_violations": _raw(Q.code_violations),
    "code_violations_narrow": _raw(
        partial(Q.code_violations, valid={S.RATE: (1, 2, 3, 4, 5, 6), S.FLAG: ("N",), S.PAYMENT: (1, 2)})
    ),
    "code_breakdown_rate": _raw(
        partial(Q.code_breakdown, col=S.RATE, valid=S.VALID_CODES[S.RATE])
    ),
    "code_breakdown_flag": _raw(
        partial(Q.code_breakdown, col=S.FLAG, valid=S.VALID_CODES[S.FLAG])
    ),
    "code_breakdown_payment": _raw(
        partial(Q.code_breakdown, col=S.PAYMENT, valid=S.VALID_CODES[S.PAYMENT])
    ),
    "negative_counts": _raw(Q.negative_counts),
    "total_mismatch": _raw(Q.total_mismatch),
    "total_mismatch_top": _raw(Q.total_mismatch_top),
    "fare_formula_flags": _raw(Q.fare_formula_flags),
    "tip_checks": _raw(Q.tip_checks),
    "mta_zero_subgroups": _raw(Q.mta_zero_subgroups),
    "airport_fee_anomalies": _raw(Q.airport_fee_anomalies),
    "airport_fee_top_zones": _raw(Q.airport_fee_top_zones),
    "airport_fee_amounts": _raw(Q.airport_fee_amounts),
    "airport_fee_amounts_one_fee": _raw(partial(Q.airport_fee_amounts, fees=("1.25",))),
    "airport_fee_zone_vendors": _raw(Q.airport_fee_zone_vendors),
    "policy_counts": _raw(Q.policy_counts),
    "unknown_zone_counts": _raw(Q.unknown_zone_counts),
    "rate_check_flat": _raw(Q.rate_check_flat),
    "rate_check_standard": _raw(Q.rate_check_standard),
    "rate_check_newark": _raw(Q.rate_check_newark),
    "rate_check_negotiated": _raw(Q.rate_check_negotiated),
    "total_check_by": _raw(Q.total_check_by),
    "negative_matrix": _raw(Q.negative_matrix),
    # outliers
    "outlier_thresholds": _rounded(O.outlier_thresholds),
    "outlier_sketches": _raw(_sketched),
    "domain_thresholds": _raw(O.domain_thresholds),
    # discrepancy study
    "add_discrepancy": _gaps(
        lambda df: df.select(
            S.ID, D.GAP, "expected_discrepancy", "implied_rate", "duration_mins",
            "duration_issue", "has_negative_amount",
        )
    ),
    "add_discrepancy_bands": _gaps(
        lambda df: D.add_discrepancy_bands(df).select(
            S.ID, "abs_discrepancy", "has_discrepancy", "discrepancy_band", "discrepancy_sign"
        )
    ),
    "discrepancy_overall": lambda spark, folder: with_rounding(
        D.discrepancy_overall(D.add_discrepancy(trips(spark, folder)))
    ),
    "discrepancy_buckets": _gaps(D.discrepancy_buckets),
    "discrepancy_signs": _gaps(D.discrepancy_signs),
    "discrepancy_by_payment": _gaps(D.by_payment),
    "discrepancy_by_vendor": _gaps(D.by_vendor),
    "discrepancy_by_month": _gaps(D.by_month),
    "discrepancy_by_hour": _gaps(D.by_hour),
    "discrepancy_by_rate": _gaps(D.by_rate),
    "discrepancy_by_zone_group": _gaps(D.by_zone_group),
    "cash_tip_recon": _gaps(D.cash_tip_recon),
    "component_diagnosis": _gaps(D.component_diagnosis),
    "modal_values": _gaps(D.modal_values),
    "modal_values_by_vendor": _gaps(D.modal_values_by_vendor),
    "modal_values_by_era": _gaps(D.modal_values_by_era),
    "medium_band_eras": _gaps(D.medium_band_eras),
    "top_gaps": _gaps(D.top_gaps),
    "rate_changed_crosstab": _gaps(D.rate_changed_crosstab),
    "rate_changed_summary": _gaps(D.rate_changed_summary),
    "rate_changed_pairs": _gaps(D.rate_changed_pairs),
    "discrepancy_zone_top_pickup": _gaps(partial(D.discrepancy_zone_top, min_trips=20)),
    "discrepancy_zone_top_dropoff": _gaps(
        partial(D.discrepancy_zone_top, zone=S.DO, min_trips=20)
    ),
    "discrepancy_zone_top_rate": _gaps(
        partial(D.discrepancy_zone_top, order_by="pct_discrepant", min_trips=20)
    ),
    "discrepancy_zone_top_pickup_100": _gaps(D.discrepancy_zone_top),
    "discrepancy_zone_top_dropoff_100": _gaps(partial(D.discrepancy_zone_top, zone=S.DO)),
    "discrepancy_zone_top_rate_100": _gaps(partial(D.discrepancy_zone_top, order_by="pct_discrepant")),
    "congestion_match": _gaps(D.congestion_match),
    "congestion_inverse": _gaps(D.congestion_inverse),
    "congestion_vendor": _gaps(D.congestion_vendor),
    "discrepancy_by_daypart_zone": _gaps(D.discrepancy_by_daypart_zone),
    # negative rows study
    "any_negative": _raw(R.negative_total),
    "negative_vs_refund": _flagged(R.negative_vs_refund),
    "refund_sides": _flagged(R.refund_sides),
    "negative_by_payment": _raw(R.negative_by_payment),
    "negative_by_vendor": _raw(R.negative_by_vendor),
    "orphan_negatives": _flagged(R.orphan_negatives),
    "orphan_by_payment": _flagged(R.orphan_by_payment),
    "negative_by_column_split": _flagged(R.negative_by_column_split),
    "negative_monthly": _raw(R.negative_monthly),
    # timestamps and durations
    "ts_flags": _raw(
        lambda df: C.ts_flags(df).select(S.ID, "vendor", "duration_mins", *C.FLAGS, C.ANY)
    ),
    "ts_headline": _raw(C.ts_headline),
    "ts_by_vendor": _raw(C.ts_by_vendor),
    "ts_range_by_vendor": _raw(C.ts_range_by_vendor),
    "neg_duration_headline": _raw(C.neg_duration_headline),
    "neg_duration_by_vendor": _raw(C.neg_duration_by_vendor),
    "neg_duration_examples": _raw(C.neg_duration_examples),
    "zero_duration_headline": _raw(C.zero_duration_headline),
    "zero_duration_by_vendor": _raw(C.zero_duration_by_vendor),
    "zero_vs_rest_payment": _raw(C.zero_vs_rest_payment),
    "issues_by_vendor": _raw(C.issues_by_vendor),
    # cleaning
    "clean_trips": lambda spark, folder: with_doubles(_clean_now(spark, folder)),
    "clean_step_1_refunds": _raw(_remove_refunds),
    "clean_step_2_disputes": _raw(_remove_disputes),
    "clean_step_3_pickup": _raw(_step_keep(3)),
    "clean_step_4_dropoff": _raw(_step_keep(4)),
    "clean_step_5_duration_flag": _raw(
        lambda df: df.select(S.ID, K.duration_flag().alias("duration_flag"))
    ),
    "clean_step_6_distance": _raw(_step_keep(6)),
    "clean_step_7_long": _raw(_step_keep(7)),
    "clean_step_8_zone": _raw(_step_keep(8)),
    "clean_step_9_fare": _raw(_step_keep(9)),
    "clean_step_10_fare_distance": _raw(_step_keep(10)),
    "clean_step_12_total": _raw(_step_keep(12)),
    "clean_steps_11_13_14_repair": _raw(
        lambda df: K.repair(df).select(S.ID, S.EXTRA, S.AIRPORT, S.CONGESTION, S.TOTAL)
    ),
    "cleaning_report": _marked(K.cleaning_report),
    "cleaning_total": _marked(K.cleaning_total),
    "revenue_by_vendor": _revenue,
    "fit_quality": lambda spark, folder: with_rounding(
        K.fit_quality(marked(spark, folder))
    ),
    # aggregates for dashboards, on the cleaned trips
    "add_calendar": _raw(
        lambda df: E.add_calendar(df).select(
            S.ID, "pickup_date", "pickup_month", "pickup_month_label", "pickup_hour",
            "pickup_weekday", "duration_min", "is_post_cbd",
        )
    ),
    "add_labels": _raw(lambda df: E.add_labels(df).select(S.ID, "payment_label", "rate_label")),
    "kpi_summary": _clean(E.kpi_summary),
    "trips_by_date": _clean(E.trips_by_date),
    "trips_by_month": _clean(E.trips_by_month),
    "histogram_distance": _clean(lambda df: with_rounding(E.histogram(df, F.col(S.DISTANCE)))),
    "histogram_duration": _clean(lambda df: with_rounding(E.histogram(df, seconds(), unit=60.0))),
    "histogram_fare": _clean(lambda df: with_rounding(E.histogram(df, F.col(S.FARE)))),
    "histogram_total": _clean(lambda df: with_rounding(E.histogram(df, F.col(S.TOTAL)))),
    "passenger_freq": _clean(E.passenger_freq),
    "label_freq_payment": _clean(partial(E.label_freq, label="payment_label")),
    "label_freq_rate": _clean(partial(E.label_freq, label="rate_label")),
    "trips_by_hour": _clean(E.trips_by_hour),
    "weekday_demand": _clean(E.weekday_demand),
    "payment_behavior": _clean(E.payment_behavior),
    "sample_points": _clean(E.sample_in_range),
    "local_trend": _clean(lambda df: with_rounding(trends.local_trend(df, S.DISTANCE, S.TOTAL, width=0.5, bandwidth=4.0), 6)),
    "top_zones_trips": _clean(E.top_zones_by_trips),
    "top_zones_revenue": _clean(E.top_zones_by_revenue),
    "demand_matrix_month_hour": _clean(partial(E.demand_matrix, a="pickup_month_label")),
    "demand_matrix_weekday_hour": _clean(partial(E.demand_matrix, a="pickup_weekday")),
    "zone_hour_demand": _clean(E.zone_hour_demand),
    "zone_payment_revenue": _clean(E.zone_payment_revenue),
    "band_matrix": _clean(E.band_matrix),
    "policy_pre_post": _clean(E.policy_pre_post),
    "zone_revenue": _clean(Z.zone_revenue),
    "zone_revenue_groups": _zone_groups,
    "zone_agg": _clean(Z.zone_agg),
    "zone_view": _zone_view("pickup", "revenue"),
    "zone_view_trips": _zone_view("dropoff", "trips"),
    "zone_kpis": _clean(lambda df: Z.zone_kpis(Z.zone_agg(df))),
    "zone_kpis_dropoff": _clean(lambda df: Z.zone_kpis(Z.zone_agg(df), "dropoff")),
}
