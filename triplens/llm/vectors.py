"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Vectors are compared inside their label only. Each of several tables hashes a vector to the signs
of its products with random planes; vectors that share a bucket of any table are compared exactly.
Equal vectors are one row with a count while they are compared. Small buckets are compared many at
a time; a large one is cut into blocks of which every pair is a unit of work, so a bucket of any
size is spread over tasks. The number of planes follows the logarithm of the label's rows, so buckets do not
grow with the table, and the number of tables follows the planes, so the recall stays. What leaves a unit is a count per vector and a spanning forest of the
links, not the pairs. A pair is counted in the first table in which it shares a bucket.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor does a vector without a label; vectors of different lengths are not compared;
rows that repeat an id are linked like other equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens.llm.common import components, stored

SIMILARITY = 0.93
# Planes of a table for the smallest labels, the most, and the rows a bucket may have if vectors are spread evenly.
PLANES, MOST_PLANES, EVEN = 12, 30, 0.25
# The share of pairs at the limit that is found.
RECALL = 0.997
# Rows of a block of a large bucket, and of a unit of small ones.
BLOCK, UNIT = 256, 4096
# Runs of equal buckets from this length on are multiplied as matrices.
RUN = 24
# Pairs whose keys are looked at together.
SLICE = 65536
SEED = 20240
"""At cosine 0.93 two signs agree with probability 0.88, so a table of 12 planes finds a pair with
probability 0.216 and 24 tables with 0.997; at 20 planes it takes 72 tables, at 30 it takes 265."""


def tables(planes_: int) -> int:
    """Tables that find a pair at the limit with probability ``RECALL``."""
    agree = 1 - np.arccos(SIMILARITY) / np.pi
    return int(np.ceil(np.log(1 - RECALL) / np.log(1 - agree**planes_)))


def planes_for(rows: Column) -> Column:
    """Planes of a table for a label of so many rows."""
    return F.greatest(F.lit(PLANES), F.least(F.lit(MOST_PLANES), F.ceil(F.log2(rows / EVEN)))).cast("int")


@lru_cache(maxsize=8)
def planes(dimension: int, planes_: int = PLANES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed + dimension).standard_normal((dimension, tables(planes_) * planes_))


def hashes(vectors: np.ndarray, planes_: int = PLANES) -> np.ndarray:
    """One bucket number per vector and table."""
    signs = (vectors @ planes(vectors.shape[1], planes_)) > 0
    return (signs.reshape(len(vectors), tables(planes_), planes_) @ (1 << np.arange(planes_))).astype(np.int32)


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (_, n), part in batch.groupby([batch["vector"].map(len), batch["planes"]]):
            part = part.drop(columns="planes")
            found = hashes(_unit(part["vector"]), int(n))
            part["keys"] = list(found)
            part["packed"] = [k.tobytes() for k in found]
            yield part


def _unit(vectors: pd.Series) -> np.ndarray:
    out = np.stack([np.asarray(v, np.float64) for v in vectors])
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what all links (a, b) of n nodes hold together."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def _pairs(run: np.ndarray, unit: np.ndarray, first: np.ndarray, second: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one bucket whose cosine is high enough. Rows are sorted by ``run``, their bucket."""
    n = len(run)
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, n])
    length = np.repeat(sizes, sizes)
    for d in range(1, RUN):
        i = np.flatnonzero((run[d:] == run[:-d]) & (length[d:] < RUN))
        if not len(i):
            break
        i = i[np.einsum("ij,ij->i", unit[i], unit[i + d]) >= SIMILARITY]
        left.append(i)
        right.append(i + d)
    for start, size in zip(starts[sizes >= RUN], sizes[sizes >= RUN], strict=True):
        part = unit[start : start + size]
        i, j = np.nonzero(np.triu(part @ part.T >= SIMILARITY, 1))
        left.append(i + start)
        right.append(j + start)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    # Of two different blocks only the pairs across are this unit's.
    mine = (first[i] == second[i]) | (block[i] != block[j])
    return i[mine], j[mine]


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Rows (node, n, near) of one unit: n counts linked vectors; near is a linked node or null."""
    out = []
    for _, rows in group.groupby(group["vector"].map(len)):
        rows = rows.sort_values(["bucket", "node"], kind="stable")
        nodes, copies, table = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["place"].to_numpy()
        i, j = _pairs(rows["bucket"].to_numpy(), _unit(rows["vector"]), rows["first"].to_numpy(), rows["second"].to_numpy(), rows["block"].to_numpy())
        labels = rows["label"].to_numpy()
        alike = labels[i] == labels[j]
        i, j = i[alike], j[alike]
        # Vectors of a label have equally many keys.
        width = rows["packed"].map(len).to_numpy() // 4
        new = np.zeros(len(i), bool)
        packed = rows["packed"].to_numpy()
        for w in np.unique(width[i]):
            of = np.flatnonzero(width[i] == w)
            ends, at = np.unique(np.concatenate([i[of], j[of]]), return_inverse=True)
            keys = np.frombuffer(b"".join(packed[ends]), np.int32).reshape(len(ends), w)
            for start in range(0, len(of), SLICE):
                part = slice(start, start + SLICE)
                same = keys[at[: len(of)][part]] == keys[at[len(of) :][part]]
                new[of[part]] = same.argmax(axis=1) == table[i[of[part]]]
        i, j = i[new], j[new]
        names, at = np.unique(nodes, return_inverse=True)
        count = np.bincount(at[i], weights=copies[j], minlength=len(names)) + np.bincount(at[j], weights=copies[i], minlength=len(names))
        out += [(names[k], int(count[k]), None) for k in np.flatnonzero(count)]
        out += [(names[a], 0, names[b]) for a, b in _forest(len(names), at[i], at[j])]
    return pd.DataFrame({"node": [r[0] for r in out], "n": [r[1] for r in out], "near": pd.array([r[2] for r in out], dtype="Int64")})


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    kind = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.col("square") > 0) & (F.col("square") < float("inf"))
    rows = rows.select("*", square.alias("square"))
    digest = F.md5(F.concat_ws(",", "label", F.to_json("vector")))
    rows = rows.select("id", "label", "vector", F.when(F.coalesce(usable, F.lit(False)), digest).alias("digest"))
    once = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").cast("bigint").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    sizes_ = rows.where(F.col("digest").isNotNull()).groupBy("label").agg(F.count("*").alias("of_label"))
    once = once.join(sizes_, "label").select(F.monotonically_increasing_id().alias("node"), *[c for c in once.columns], planes_for(F.col("of_label")).alias("planes"))
    schema = f"node bigint, digest string, least bigint, copies bigint, label string, vector {kind}, keys array<int>, packed binary"
    once = stored(once.mapInPandas(_hash, schema), "vectors")
    members = once.select("node", "label", F.size("vector").alias("size"), F.posexplode("keys").alias("place", "key"))
    members = members.select("node", "place", F.xxhash64("label", "size", "place", "key").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    units = max(1, once.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] // UNIT)
    # A small bucket belongs to a unit of many; a large one is blocks by hash of about BLOCK rows.
    small_ = F.col("rows") <= 2 * BLOCK
    plan = sizes.select("bucket", F.when(small_, F.pmod("bucket", F.lit(units))).otherwise(-1 - F.pmod("bucket", F.lit(1 << 62))).alias("unit"), F.when(small_, F.lit(1)).otherwise(F.ceil(F.col("rows") / BLOCK)).cast("int").alias("blocks"))
    held = members.join(plan, "bucket").select("*", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int").alias("block"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("first"), F.greatest("block", o).alias("second")))
    spread = held.select("node", "place", "bucket", "unit", "block", F.inline(pair))
    data = spread.join(once.select("node", "label", "vector", "packed", "copies"), "node")
    found = data.groupBy("unit", "first", "second").applyInPandas(_compare, "node bigint, n bigint, near bigint")
    found = stored(found, "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    edges = found.where("near is not null").select(F.col("node").alias("a"), F.col("near").alias("b"))
    named = components(edges)
    nodes = once.select("node", "digest", "least", "copies").join(counts, "node", "left").join(named, "node", "left")
    nodes = nodes.select("digest", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    nodes = stored(nodes, "nodes")
    first = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(first, "component").select("digest", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "digest").join(nodes, "digest", "left")
    component = F.coalesce("component_id", F.col("id").cast("bigint"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
