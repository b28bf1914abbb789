"""Previous and next row in the order of a unique whole-number key, without a global sort.

A window over the whole table would put every row into one task. Instead the key's upper
bits split the table into blocks. As keys are unique, a block of ``2**20`` keys can never hold
more rows than that, whatever the data looks like. Each block only lacks the row just before
and just after it. Those come from the blocks' own first and last rows, whose order is found
the same way one level up, and they enter a block as guest rows that are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.sources.shared import pin, shared_folder

# Bits per level. What remains of a 64-bit key (22 bits) bounds the topmost, unsplit level.
BITS, TOP_BITS = 20, 22
LEVELS = (BITS, 64 - BITS - TOP_BITS)
_BLOCK, _GUEST = "_block", "_guest"


def _add_lag_lead(
    df: DataFrame, window, lag_cols: Sequence[str], lead_cols: Sequence[str]
) -> DataFrame:
    return df.select(
        "*",
        *[F.lag(c).over(window).alias(f"prev_{c}") for c in lag_cols],
        *[F.lead(c).over(window).alias(f"next_{c}") for c in lead_cols],
    )


def _link(
    df: DataFrame,
    key: str,
    lag_cols: Sequence[str],
    lead_cols: Sequence[str],
    levels: Sequence[int],
) -> DataFrame:
    if not levels:
        return _add_lag_lead(df, W.orderBy(key), lag_cols, lead_cols)

    depth = len(levels)
    block = f"{_BLOCK}{depth}"
    first_key, last_key = f"first{depth}_{key}", f"last{depth}_{key}"
    first = {c: f"first{depth}_{c}" for c in lead_cols}
    last = {c: f"last{depth}_{c}" for c in lag_cols}

    blocked = df.withColumn(block, F.shiftright(key, levels[0]))
    ends = blocked.groupBy(block).agg(
        F.min(key).alias(first_key),
        F.max(key).alias(last_key),
        *[F.min_by(c, key).alias(name) for c, name in first.items()],
        *[F.max_by(c, key).alias(name) for c, name in last.items()],
    )
    linked = _link(
        ends, block, [last_key, *last.values()], [first_key, *first.values()], levels[1:]
    )
    # The row before the block carries what lag needs, the row after it what lead needs.
    before = {key: f"prev_{last_key}"} | {c: f"prev_{n}" for c, n in last.items()}
    after = {key: f"next_{first_key}"} | {c: f"next_{n}" for c, n in first.items()}
    types = dict(df.dtypes)
    names = [key, *dict.fromkeys([*lag_cols, *lead_cols])]

    def guest(source: dict[str, str]) -> Column:
        return F.struct(
            *[
                (F.col(source[c]) if c in source else F.lit(None)).cast(types[c]).alias(c)
                for c in names
            ]
        )

    guests = (
        linked.select(block, F.inline(F.array(guest(before), guest(after))))
        .where(F.col(key).isNotNull())
        .withColumn(_GUEST, F.lit(True))
    )
    rows = blocked.withColumn(_GUEST, F.lit(False)).unionByName(guests, allowMissingColumns=True)
    window = W.partitionBy(block).orderBy(key)
    return (
        _add_lag_lead(rows, window, lag_cols, lead_cols).where(~F.col(_GUEST)).drop(block, _GUEST)
    )


def levels_for(df: DataFrame, key: str = S.ID) -> tuple[int, ...]:
    """Fewer levels if the range of the keys proves that there can be few blocks.

    Reads one column, and saves one level of shuffles for keys that are not spread thinly.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    blocks = 0 if low is None else (high >> BITS) - (low >> BITS) + 1
    return LEVELS[:1] if blocks <= 1 << TOP_BITS else LEVELS


def ordered_neighbours(
    df: DataFrame,
    cols: Sequence[str],
    key: str = S.ID,
    levels: Sequence[int] | None = None,
) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for each column, in order of the unique integer key.

    The levels follow from the range of the keys unless given.
    """
    if dict(df.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{key} must be a whole number")
    rows = df.withColumn(key, F.col(key).cast("bigint"))
    used = levels_for(rows, key) if levels is None else levels
    return _link(rows, key, list(cols), list(cols), list(used))


# Rows that a block of an order by other keys may hold, by a count of the rows.
BLOCK_ROWS = 1 << 20


def neighbours_in_order(
    df: DataFrame, cols: Sequence[str], order: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for each column, in the order of columns of any type, nulls first.

    Rows are dealt into blocks of about equal size by sampled split points of the order, and the blocks are stored.
    Each block lacks the row before and after it; these are the last and first rows of the blocks
    next to it, which are looked up among the ends of the blocks, two rows a block, and join it as guests. The
    order should tell all rows apart (end it with an id): equal ones are neighbours of each other in no fixed order, and
    fall into one block.
    """
    names = list(dict.fromkeys([*order, *cols]))
    blocks = max(1, -(-df.count() // block_rows), df.sparkSession.sparkContext.defaultParallelism)
    held = pin(df.repartitionByRange(blocks, *[F.col(c).asc_nulls_first() for c in order]).withColumn(_BLOCK, F.spark_partition_id()))
    place, row = F.struct(*order), F.struct(*names)
    ends = held.groupBy(_BLOCK).agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    every = ends.agg(F.array_sort(F.collect_list(F.struct(_BLOCK, "first", "last"))).alias("e"))
    around = F.transform(
        "e",
        lambda x, i: F.struct(
            x[_BLOCK].alias(_BLOCK),
            F.array(F.get("e", i - 1)["last"], F.get("e", i + 1)["first"]).alias("guests"),
        ),
    )
    guests = every.select(F.inline(around)).select(_BLOCK, F.explode("guests").alias("g")).where("g is not null")
    guests = guests.select(_BLOCK, *[F.col(f"g.`{c}`").alias(c) for c in names], F.lit(True).alias(_GUEST))
    rows = held.withColumn(_GUEST, F.lit(False)).unionByName(guests, allowMissingColumns=True)
    window = W.partitionBy(_BLOCK).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return _add_lag_lead(rows, window, cols, cols).where(~F.col(_GUEST)).drop(_BLOCK, _GUEST)


def _levels_for_pinned(pinned: DataFrame, key: str) -> tuple[int, ...]:
    """No blocks at all for a set that was counted and fits into one."""
    if shared_folder(pinned.sparkSession) is not None and pinned.count() <= 1 << BITS:
        return ()
    return levels_for(pinned, key)


def equals_neighbour(
    df: DataFrame, col: str, key: str = S.ID, levels: Sequence[int] | None = None
) -> DataFrame:
    """Rows whose value equals that of the previous or the next row; null equals nothing."""
    linked = ordered_neighbours(df, [col], key, levels)
    same = (F.col(col) == F.col(f"prev_{col}")) | (F.col(col) == F.col(f"next_{col}"))
    return linked.where(same).select(*df.columns)


def refund_rows(
    df: DataFrame,
    cols: Sequence[str] = (S.PICKUP, S.DROPOFF, S.PU),
    key: str = S.ID,
    levels: Sequence[int] | None = None,
) -> DataFrame:
    """Ids of rows that pass one neighbour test per column, each among the survivors so far.

    Neighbours change after each test, so the tests cannot be merged. Survivors are pinned
    between them: they are read twice by the next test and are usually few.
    """
    rows = df.select(key, *cols)
    used = levels_for(df, key) if levels is None else levels
    for i, col in enumerate(cols):
        if i and levels is None:
            used = _levels_for_pinned(rows, key)
        rows = pin(equals_neighbour(rows, col, key, used))
    return rows.select(key)


def dispute_rows(
    df: DataFrame,
    code: int = 4,
    col: str = S.PICKUP,
    key: str = S.ID,
    levels: Sequence[int] | None = None,
) -> DataFrame:
    """Ids of disputed rows with the same pickup time as the dispute just before or after."""
    rows = pin(df.where(F.col(S.PAYMENT) == code).select(key, col))
    used = _levels_for_pinned(rows, key) if levels is None else levels
    return pin(equals_neighbour(rows, col, key, used).select(key))
