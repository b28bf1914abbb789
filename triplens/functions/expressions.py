"""Small column builders shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens import schema as S

GAP_TYPE = "decimal(14,2)"
SECONDS_TYPE = "decimal(18,6)"


def money(amount: str | int) -> Column:
    """A decimal literal, so money never turns into binary floating point."""
    return F.lit(Decimal(str(amount)))


def instant(text: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def cents(col: str) -> Column:
    """Money as whole cents: sums of it are plain long additions, as exact and much cheaper."""
    return (F.col(col) * 100).cast("bigint")


def from_cents(col: Column) -> Column:
    return (col.cast("decimal(20,0)") * money("0.01")).cast("decimal(20,2)")


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; null when the whole is zero."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def share_of_all(n: str, *by: str) -> Column:
    """Each row's share of the sum over its group. Only for tables that are already aggregated."""
    return share(F.col(n), F.sum(n).over(W.partitionBy(*by) if by else W.partitionBy()))


def exact(col: Column | str) -> Column:
    """A measure as a decimal, so that its sum does not depend on the order of the rows."""
    if isinstance(col, str) and col in S.MONEY:
        return F.col(col)
    return (F.col(col) if isinstance(col, str) else col).cast(SECONDS_TYPE)


def mean(col: Column | str, where: Column | None = None) -> Column:
    """Mean over non-null values (of the rows that pass ``where``); null when there are none."""
    value = exact(col)
    if where is not None:
        value = F.when(where, value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def total(col: Column | str) -> Column:
    return F.sum(F.col(col) if isinstance(col, str) else col).cast("double")


def either(predicates: Iterable[Column]) -> Column:
    return reduce(or_, predicates)


def both(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates)


def is_in(col: str, values: Iterable) -> Column:
    """Membership test that is false, not null, for a null value."""
    return F.coalesce(F.col(col).isin(*values), F.lit(False))


def seconds(start: str = S.PICKUP, end: str = S.DROPOFF) -> Column:
    """Elapsed seconds with microseconds; no time zone is involved."""
    gap = F.col(end) - F.col(start)
    return gap.cast("interval second").cast(SECONDS_TYPE)


def minutes(start: str = S.PICKUP, end: str = S.DROPOFF) -> Column:
    return seconds(start, end).cast("double") / F.lit(60.0)


def parts_sum(parts: Iterable[str], zero_if_null: Iterable[str] = ()) -> Column:
    """Sum of the components; one null component makes it null unless listed as zero_if_null."""
    filled = set(zero_if_null)
    terms = [F.coalesce(F.col(p), money(0)) if p in filled else F.col(p) for p in parts]
    return sum(terms[1:], terms[0]).cast(GAP_TYPE)


def total_gap(parts: Iterable[str] = S.PARTS, zero_if_null: Iterable[str] = ()) -> Column:
    """Recorded total minus the sum of its components."""
    return (F.col(S.TOTAL) - parts_sum(parts, zero_if_null)).cast(GAP_TYPE)


def in_long_form(row: DataFrame, *records: dict[str, Column]) -> DataFrame:
    """Turn each (short) row into several, one per record of named columns."""
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in records]
    return row.select(F.inline(F.array(*structs)))
