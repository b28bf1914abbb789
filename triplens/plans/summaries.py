"""The summaries of the cleaned trips that figures and dashboards are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from triplens.operators import eda as E
from triplens.operators import zones as Z


def summaries(clean: DataFrame) -> dict[str, DataFrame]:
    """By name, the number of the figure first; figures without numbers of their own have none here."""
    return {
        "00_kpi": E.kpi_summary(clean),
        "U01_trips_by_date": E.trips_by_date(clean),
        "U02_trips_by_month": E.trips_by_month(clean),
        "U07_passenger_count": E.passenger_freq(clean),
        "U08_payment_type": E.label_freq(clean, "payment_label"),
        "U09_ratecode": E.label_freq(clean, "rate_label"),
        "B01_trips_by_hour": E.trips_by_hour(clean),
        "B02_weekday_demand": E.weekday_demand(clean),
        "B03_payment_behavior": E.payment_behavior(clean),
        "B06_zones_by_trips": E.top_zones_by_trips(clean),
        "B07_zones_by_revenue": E.top_zones_by_revenue(clean),
        "M01_month_hour": E.demand_matrix(clean, "pickup_month_label"),
        "M02_weekday_hour": E.demand_matrix(clean, "pickup_weekday"),
        "M03_zone_hour": E.zone_hour_demand(clean),
        "M04_zone_payment": E.zone_payment_revenue(clean),
        "M05_distance_duration": E.band_matrix(clean),
        "M06_policy": E.policy_pre_post(clean),
        "zone_revenue": Z.zone_revenue(clean),
    }
