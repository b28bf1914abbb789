"""Exact k-means of integer vectors by Shallot search.

Every vector remembers its nearest and second-nearest centroid, an upper bound of its distance to the first and a lower
bound of its distance to all others. When centroids have moved, the bounds move with them; a vector whose upper bound is still below
its lower bound, or below half the way to its centroid's nearest neighbour, stays without a comparison. Else the
distances to both remembered centroids are computed and the search starts from the closer one, h: its neighbours are
scanned from near to far, and a centroid j can only matter while d(h, j) <= d(x, h) + d(x, second), a ball that shrinks whenever a
nearer second is found. What survives is compared by squared distance in integers; bounds are doubles with a margin, so they
never decide between equal distances. Ties go to the smaller number.

Vectors are kept in blocks together with their bounds; a round writes the blocks anew, with each block's sums by cluster,
and only sums of clusters reach the driver. The table of the round before is then deleted.

Defined results: vectors of another length than ``length``, or that are null or hold an entry that is null, not
finite or too large for a long integer, are left out; rows that repeat an id are vectors of their own (as
starts, those of equal id are ordered by their integers); a null id hashes as the text "null"; with fewer vectors
than ``k`` each is a start; an empty table gives no rows; a distance or inertia beyond a long integer is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens.llm.blocks import blocks, halves, scaled, stored_blocks, total, unpack
from triplens.llm.common import released

CLUSTERS, ROUNDS, LENGTH = 40, 5, 64
# Bounds are widened by this share: far more than rounding adds, far less than they are apart.
MARGIN = 1e-9
# Integers up to here have exact squared distances in 64 bits for vectors of up to 256 entries.
EXACT = 2**26


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distances of the rows of x and c, exact: long integers, or Python's where those are too short."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > EXACT or x.shape[-1] > 256:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=1)


def root(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


class Centroids:
    """Centroids with what the search needs of them: neighbours in order, half gaps, and how far they moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        apart = np.stack([root(squared(np.broadcast_to(c, at.shape), at)) for c in at])
        np.fill_diagonal(apart, np.inf)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, : k - 1]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = root(squared(before, at)) if before is not None else np.zeros(k)
        self.moved = moved
        # The farthest move among the others.
        far = np.argsort(-moved, kind="stable")
        self.others = np.full(k, moved[far[0]])
        self.others[far[0]] = moved[far[1]] if k > 1 else 0.0


def first_search(x: np.ndarray, c: Centroids) -> dict:
    """Nearest and second-nearest of every vector, from all distances."""
    k = len(c.at)
    a, best = np.zeros(len(x), np.int32), squared(x, c.at[0])
    b, second = np.full(len(x), -1, np.int32), None
    for j in range(1, k):
        d = squared(x, c.at[j])
        near = d < best
        if second is None:
            second, b = np.where(near, best, d), np.where(near, 0, j).astype(np.int32)
        else:
            next_ = ~near & (d < second)
            second = np.where(near, best, np.where(next_, d, second))
            b = np.where(near, a, np.where(next_, j, b)).astype(np.int32)
        a, best = np.where(near, j, a).astype(np.int32), np.where(near, d, best)
    low = np.full(len(x), np.inf) if second is None else root(second)
    return {"a": a, "b": b, "up": root(best), "low": low}


def search(x: np.ndarray, state: dict, c: Centroids) -> dict:
    """Nearest and second-nearest after the centroids have moved."""
    a, b = state["a"].copy(), state["b"].copy()
    up, low = state["up"] + c.moved[a], state["low"] - c.others[a]
    limit = np.maximum(low, c.half[a]) * (1 - MARGIN)
    rows = np.flatnonzero(up * (1 + MARGIN) >= limit)
    first = squared(x[rows], c.at[a[rows]])
    up[rows] = root(first)
    open_ = up[rows] * (1 + MARGIN) >= limit[rows]
    rows, first = rows[open_], first[open_]
    if not len(rows) or len(c.at) == 1:
        return {"a": a, "b": b, "up": up, "low": low}
    x = x[rows]
    na, nb, second = a[rows], b[rows], squared(x, c.at[b[rows]])
    swap = (second < first) | ((second == first) & (nb < na))
    na, nb, first, second = np.where(swap, nb, na), np.where(swap, na, nb), np.where(swap, second, first), np.where(swap, first, second)
    # The ball's centre and radius to it stay; what is added to the radius shrinks.
    centre, other, reach, add = na.copy(), nb.copy(), root(first), root(second)
    live = np.arange(len(rows))
    for step in range(len(c.at) - 1):
        h = centre[live]
        live = live[c.apart[h, step] * (1 - MARGIN) <= (reach[live] + add[live]) * (1 + MARGIN)]
        if not len(live):
            break
        j = c.order[centre[live], step]
        new = j != other[live]
        at, j = live[new], j[new]
        if not len(at):
            continue
        d = squared(x[at], c.at[j])
        near = (d < first[at]) | ((d == first[at]) & (j < na[at]))
        next_ = ~near & (d < second[at])
        second[at] = np.where(near, first[at], np.where(next_, d, second[at]))
        nb[at] = np.where(near, na[at], np.where(next_, j, nb[at]))
        first[at], na[at] = np.where(near, d, first[at]), np.where(near, j, na[at])
        add[at] = root(second[at])
    a[rows], b[rows], up[rows], low[rows] = na, nb, root(first), add
    return {"a": a, "b": b, "up": up, "low": low}


STATE = (("a", np.int32), ("b", np.int32), ("up", np.float64), ("low", np.float64))


def assigned(held: DataFrame, c: Centroids, first: bool) -> DataFrame:
    """The blocks with the vectors' state after one assignment."""
    kind = dict(held.dtypes)["ids"]
    names = ["ids", "n", "width", "x", *[s for s, _ in STATE]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, block in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                x = unpack(block)
                state = first_search(x, c) if first else search(x, {s: np.frombuffer(block[s], t) for s, t in STATE}, c)
                own = [pa.array([state[s].astype(t).tobytes()], pa.binary()) for s, t in STATE]
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1), pa.array([block["n"]], pa.int32()), pa.array([block["width"]], pa.int32()), pa.array([block["x"]], pa.binary()), *own], names=names)

    return held.mapInArrow(each, f"ids {kind}, n int, width int, x binary, a binary, b binary, up binary, low binary")


def cluster_sums(held: DataFrame, k: int) -> list[tuple[int, list[int]]]:
    """(count, sums of the components) of each cluster, exact."""

    def sums(block: dict) -> list[int]:
        x, a = unpack(block), np.frombuffer(block["a"], np.int32)
        order = np.argsort(a, kind="stable")
        counts = np.bincount(a, minlength=k)
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        high, low = (np.zeros((k, x.shape[1]), object) for _ in range(2))
        for out, part in ((high, halves(x)[0]), (low, halves(x)[1])):
            out[full] = np.add.reduceat(part[order], starts, axis=0)
        return [v for i in range(k) for v in [counts[i], *(high[i] * 2**32 + low[i])]]

    found = total(held.select("n", "width", "x", "a"), sums)
    width = len(found) // k
    return [(found[i * width], found[i * width + 1 : (i + 1) * width]) for i in range(k)]


def clusters(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector."""
    kind = dict(table.dtypes)[key]
    schema = f"{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    rows = scaled(table, key, vector, length)
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    starts = rows.orderBy(digest, "x").limit(k).select("x").collect()
    if not starts:
        return table.sparkSession.createDataFrame([], schema)
    c = Centroids(np.array([r.x for r in starts], np.int64))
    k = len(c.at)
    held = stored_blocks(blocks(rows))
    for turn in range(rounds + 1):
        last, held = held, stored_blocks(assigned(held, c, turn == 0))
        released(last)
        if turn < rounds:
            sums = cluster_sums(held, k)
            moved = [[v // count for v in of] if count else old.tolist() for (count, of), old in zip(sums, c.at, strict=True)]
            c = Centroids(np.array(moved, np.int64), c.at)
    at = c.at

    def distances(block: dict) -> np.ndarray:
        return squared(unpack(block), at[np.frombuffer(block["a"], np.int32)])

    def inertias(block: dict) -> list[int]:
        out = [0] * k
        for i, d in zip(np.frombuffer(block["a"], np.int32).tolist(), distances(block).tolist(), strict=True):
            out[i] += d
        return out

    def fits(value: int) -> int | None:
        return value if value < 2**63 else None

    own = total(held.select("n", "width", "x", "a"), inertias)
    own, whole = [fits(v) for v in own], fits(sum(own))
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in at.tolist()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, block in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                a = np.frombuffer(block["a"], np.int32).tolist()
                columns = [ids.slice(i, 1).flatten(), pa.array(a, pa.int32()), pa.array([fits(d) for d in distances(block).tolist()], pa.int64())]
                columns += [pa.array([own[j] for j in a], pa.int64()), pa.array([whole] * len(a), pa.int64()), pa.array([names[j] for j in a], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return held.select("ids", "n", "width", "x", "a").mapInArrow(each, schema)
