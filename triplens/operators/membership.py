"""Removal of large sets of ids without moving the rows that cannot be in them.

Ids are hashed to blocks of ``WORDS`` integers, in which each sets ``MARKS`` bits. A row whose bits are not all set is
in no set and stays where it is; only the others, the true ones and about one in seventy of the rest, are shuffled for
the exact join. The blocks are built and probed by built-ins, and one row holds a block, so their size is known from
the count of ids: two bytes an id.

Rows with a null id stay. Ids may repeat and may be null; an empty set removes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens import schema as S
from triplens.operators.duplicates import remove_rows
from triplens.sources.shared import BROADCAST_ROWS, pin, shared_folder

# Integers of a block, bits that an id sets, and bits that are held for each id.
WORDS, MARKS, BITS_PER_ID = 1024, 2, 16
# Up to this many ids the blocks, 200 MB then, are sent to every executor.
FILTER_IDS = 100_000_000


def blocks_for(ids: int) -> int:
    return max(1, -(-ids * BITS_PER_ID // (WORDS * 64)))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _marks(key: str) -> list[tuple[Column, Column]]:
    """(word, bit) of each mark of a key: sixteen bits of a second hash."""
    second = F.xxhash64(F.lit(1), key)
    cuts = [F.shiftrightunsigned(second, 16 * i) for i in range(MARKS)]
    return [(F.shiftright(c, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"), c.bitwiseAND(F.lit(63)).cast("int")) for c in cuts]


def id_blocks(ids: DataFrame, blocks: int, key: str = S.ID) -> DataFrame:
    """(_block, _words): the bits of a set of ids, one row a block."""
    marks = F.array(*[F.struct(w.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), b).alias("_bits")) for w, b in _marks(key)])
    of_ids = ids.where(F.col(key).isNotNull()).select(_block(key, blocks).alias("_block"), F.inline(marks))
    place = F.col("id")
    empty = ids.sparkSession.range(blocks * WORDS).select(
        F.floor(place / WORDS).cast("int").alias("_block"), (place % WORDS).cast("int").alias("_word"), F.lit(0).cast("bigint").alias("_bits")
    )
    words = of_ids.unionByName(empty).groupBy("_block", "_word").agg(F.bit_or("_bits").alias("_bits"))
    # Every word of a block occurs once, so a block is an array of WORDS integers.
    held = words.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_held"))
    return held.select("_block", F.col("_held._bits").alias("_words"))


def may_be_in(df: DataFrame, blocks: DataFrame, n_blocks: int, key: str = S.ID) -> DataFrame:
    """``df`` with ``_maybe``: false for rows whose id is surely not in the set."""
    held = F.broadcast(blocks.withColumnRenamed("_block", "_of_block"))
    joined = df.join(held, _block(key, n_blocks) == F.col("_of_block"), "left")
    maybe = F.col(key).isNotNull()
    for word, bit in _marks(key):
        maybe = maybe & (F.getbit(F.get("_words", word), bit) == 1)
    return joined.select(*[df[c] for c in df.columns], F.coalesce(maybe, F.lit(False)).alias("_maybe"))


def remove_known(df: DataFrame, ids: DataFrame, key: str = S.ID, broadcast_ids: int = BROADCAST_ROWS, filter_ids: int = FILTER_IDS) -> DataFrame:
    """Drop the rows whose id is in a pinned set, by the way that its count allows.

    A small set is broadcast; a larger one is first tested by its blocks, and only rows that may be in it are joined;
    one beyond ``filter_ids`` is joined with all rows. The result is the same each time.
    """
    if shared_folder(df.sparkSession) is None:
        return remove_rows(df, ids, key)
    n = ids.count()
    if n <= broadcast_ids:
        return remove_rows(df, F.broadcast(ids), key)
    if n > filter_ids:
        return remove_rows(df, ids, key)
    n_blocks = blocks_for(n)
    tested = may_be_in(df, pin(id_blocks(ids, n_blocks, key)), n_blocks, key)
    # The set is not broadcast here: at this size it is as wide as the rows that are left to test.
    sure = tested.where(~F.col("_maybe")).drop("_maybe")
    rest = remove_rows(tested.where("_maybe").drop("_maybe"), ids.select(key).hint("merge"), key)
    return sure.unionByName(rest.select(*df.columns))
