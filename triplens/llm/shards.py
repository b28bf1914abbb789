"""Rendezvous hashing of record keys over weighted shards, with gapless places inside each shard.

A key goes to the shard of the greatest score ``-weight / ln(u)``, where u is a hash of key and
shard in (0, 1). A new shard takes the keys whose score is greatest there and moves no other; a
shard's share follows its weight. Key and shard count alone decide.

Defined results: a null key is a key of its own; a null text has one byte of size (the record's
end) and the checksum of the empty text; rows that repeat key and text get places of their own.
A key of very many rows with different texts, the null key included, is cut by size and checksum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 16
# A key with more than one in HOT of all rows is cut into chunks of its own, so there are fewer than HOT of them.
HOT = 4096
# Cuts of such a key. All cuts together are at most HOT * CUTS longs, 34 MB.
CUTS = 1023


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Of equal scores the lower shard wins."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((F.lit(-float(w)) / F.ln(unit_hash(name, F.lit(str(i))))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["i"]).cast("int")


def placed(rows: DataFrame, group: str, chunk: str, order: Sequence[str]) -> DataFrame:
    """The distinct columns of ``rows`` repeated as often as they occur, with ``slot`` 0, 1, .. per group.

    No group meets in one task, and no key if chunks cut it. Rows are counted by all their columns and input partition; running
    sums inside a chunk (a hash range of the order) and over the chunks of a group give the first
    slot of each count. A row that repeats without end is one count per partition.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns, F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n"))
    inside = W.partitionBy(group, chunk).orderBy(*order, "_part").rowsBetween(W.unboundedPreceding, -1)
    started = counted.select("*", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_start"))
    totals = rows.groupBy(group, chunk).agg(F.count("*").alias("_total"))
    before = W.partitionBy(group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(group, chunk, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    joined = started.join(totals, [group, chunk])
    return joined.select(*columns, F.explode(F.sequence(F.col("_before") + F.col("_start"), F.col("_before") + F.col("_start") + F.col("_n") - 1)).alias("slot"))


def hot_keys(name: Column, docs: DataFrame, share: int = HOT) -> list[str]:
    """The hashes of keys with more than one in ``share`` of all rows: fewer than ``share`` of them."""
    total = docs.count()
    counted = docs.groupBy(F.md5(name).alias("_hash")).agg(F.count("*").alias("_n"))
    return sorted(r["_hash"] for r in counted.where(F.col("_n") * share > total).select("_hash").collect())


def chunked(rows: DataFrame, hot: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """``rows`` with ``_chunk``, a range of the order (_order, size, text_crc32): digits of the hash, for hot keys more.

    Between two chunks of digits, a hot key's rows are cut at quantiles of size and checksum; rows of other keys that
    share its digits come before or after all of these.
    """
    digits = F.substring("_order", 1, 3)
    if not hot:
        return rows.select("*", digits.alias("_chunk"))
    at = F.shiftleft("size", 32) + F.col("text_crc32")
    marks = [i / (cuts + 1) for i in range(1, cuts + 1)]
    quantiles = rows.where(F.col("_order").isin(list(hot))).groupBy("_order").agg(F.array_distinct(F.percentile_approx(at, marks)).alias("_cuts"))
    quantiles = quantiles.select(F.substring("_order", 1, 3).alias("_digits"), F.struct(F.col("_order").alias("key"), F.col("_cuts").alias("cuts")).alias("_hot"))
    per_digits = F.broadcast(quantiles.groupBy("_digits").agg(F.collect_list("_hot").alias("_hots")))
    joined = rows.join(per_digits, digits == F.col("_digits"), "left")
    below = F.size(F.filter("_hots", lambda h: h["key"] < F.col("_order")))
    own = F.get(F.filter("_hots", lambda h: h["key"] == F.col("_order")), F.lit(0))["cuts"]
    cut = F.size(F.filter(own, lambda c: c < at))
    # A row of another key comes after ``below`` hot keys; a hot key's own rows come after those.
    inner = F.concat(F.lpad((2 * below + F.when(own.isNull(), 0).otherwise(1)).cast("string"), 5, "0"), F.lpad(F.when(own.isNull(), 0).otherwise(cut).cast("string"), 5, "0"))
    chunk = F.concat(digits, F.when(F.col("_hots").isNull(), F.lit("")).otherwise(inner))
    return joined.select(*rows.columns, chunk.alias("_chunk"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row; grown_shard has one more shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    grown = [*weights, new_weight]
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
        F.md5(name).alias("_order"),
    )
    rows = chunked(rows, hot_keys(name, docs))
    return placed(rows, "shard", "_chunk", ["_order", "size", "text_crc32"]).select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
