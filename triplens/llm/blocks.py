"""Vectors as integers, in blocks that numpy takes whole, and exact sums of what blocks give.

A block is one row: the ids of up to ``ELEMENTS`` / length vectors and their integers as bytes, in the narrowest
width that holds them. An integer x stands for the entry c as floor(256 * c).

Defined results: a vector that is null or holds an entry that is null, not finite, or too large for a
long integer is left out; ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens.llm.common import stored

SCALE = 256.0
# Integers of one block: 8 MB as numpy takes them.
ELEMENTS = 1_000_000


def scaled(table: DataFrame, key: str, vector: str, length: int | None = None) -> DataFrame:
    """(id, x): the usable vectors as arrays of long integers; ``length`` leaves out all others."""
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * F.lit(SCALE) >= F.lit(2.0**63)))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    if length is not None:
        rows = rows.where(F.size("v") == length)
    return rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(SCALE)).cast("bigint")).alias("x"))


def pack(x: np.ndarray) -> tuple[int, bytes]:
    for width in (2, 4):
        kind = np.dtype(f"<i{width}")
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return width, x.astype(kind).tobytes()
    return 8, x.astype("<i8").tobytes()


def unpack(block: dict) -> np.ndarray:
    return np.frombuffer(block["x"], f"<i{block['width']}").astype(np.int64).reshape(block["n"], -1)


def blocks(rows: DataFrame) -> DataFrame:
    """(ids, n, width, x) of the rows (id, x), whose arrays are of one length."""
    kind = dict(rows.dtypes)["id"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            if not len(lists):
                continue
            x = np.asarray(lists.flatten()).astype(np.int64).reshape(len(lists), -1)
            step = max(1, ELEMENTS // max(1, x.shape[1]))
            for at in range(0, len(x), step):
                width, data = pack(x[at : at + step])
                own = ids.slice(at, step)
                held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([held, pa.array([len(own)], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary())], names=["ids", "n", "width", "x"])

    return rows.select("id", "x").mapInArrow(make, f"ids array<{kind}>, n int, width int, x binary")


def stored_blocks(df: DataFrame) -> DataFrame:
    """Blocks in the shared folder: passes read bytes and nothing is computed again."""
    return stored(df, "blocks")


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as two: their sums over a block cannot overflow."""
    return values >> 32, values & 0xFFFFFFFF


def total(blocks_: DataFrame, sums: Callable[[dict], np.ndarray | list[int]]) -> list[int]:
    """The exact sums, cell by cell, of the integers that ``sums`` gives for each block (a dict of its columns)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[int] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                found = [int(v) for v in sums(row)]
                whole = found if whole is None else [a + b for a, b in zip(whole, found, strict=True)]
        if whole is not None:
            values = pa.array([Decimal(v) for v in whole], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), values], names=["cell", "v"])

    found = blocks_.mapInArrow(each, "cell int, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    return [int(r.v) for r in sorted(found, key=lambda r: r.cell)]


def summed(blocks_: DataFrame, sums: Callable[[dict], np.ndarray]) -> np.ndarray:
    """The sums of the matrices of doubles that ``sums`` gives for each block; one matrix leaves a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for row in batch.to_pylist():
                found = sums(row)
                whole = found if whole is None else whole + found
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(whole.size), pa.int32()), pa.array(whole.ravel(), pa.float64())], names=["cell", "v"])

    found = blocks_.mapInArrow(each, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(found, key=lambda r: r.cell)])
