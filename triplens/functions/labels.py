"""Code-to-name tables. Each study keeps its own wording, so there are several per code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names used by the audit studies.
STUDY_PAYMENT = {
    1: "1-Credit card",
    2: "2-Cash",
    3: "3-No charge",
    4: "4-Dispute",
    5: "5-Unknown",
    6: "6-Voided",
}
STUDY_VENDOR = {1: "1-CMT", 2: "2-Curb Mobility", 6: "6-Myle Technologies", 7: "7-Helix"}
SHORT_VENDOR = {1: "1-CMT", 2: "2-Curb Mobility", 6: "6-Myle", 7: "7-Helix"}
STUDY_RATE = {
    1: "1 - Standard Metered",
    2: "2 - JFK Flat Rate",
    3: "3 - Newark",
    4: "4 - Nassau/Westchester",
    5: "5 - Negotiated",
    6: "6 - Group Ride",
}

# Names used by the timestamp study.
CLOCK_VENDOR = {1: "CMT", 2: "Curb Mobility", 6: "Myle Technologies", 7: "Helix"}
CLOCK_PAYMENT = {
    1: "1 - Credit Card",
    2: "2 - Cash",
    3: "3 - No Charge",
    4: "4 - Dispute",
    5: "5 - Unknown",
    6: "6 - Voided Trip",
}

# Names used by the dashboards.
DASHBOARD_PAYMENT = {
    0: "Flex Fare",
    1: "Credit Card",
    2: "Cash",
    3: "No Charge",
    4: "Dispute",
    5: "Unknown",
    6: "Voided",
}
DASHBOARD_RATE = {
    1: "Standard",
    2: "JFK",
    3: "Newark",
    4: "Nassau/Westchester",
    5: "Negotiated",
    6: "Group Ride",
    99: "Unknown",
}
MISSING = "Missing/Invalid"


def label(code: str, names: Mapping[int, str], default: str) -> Column:
    """Name of a code; a null or unlisted code gets the default."""
    out = F
    for value, name in names.items():
        out = out.when(F.col(code) == value, name)
    return out.otherwise(default)
