"""Whitening of vectors by Chebyshev-filtered subspace iteration over distributed passes.

Vectors become integers x = floor(256 * c). Every different x counts once: that is the fit list, kept as blocks of
integers. A pass multiplies its covariance V with a thin matrix Q: tasks add up Xc'(Xc Q), Xc being x less the exact
mean, and only that thin matrix is summed. Q is filtered by a Chebyshev polynomial of V, built by its three-term recurrence, one
pass for each degree; it is small on the interval from 0 to the least Ritz value of the block, where the unwanted
spectrum lies, and grows fast above. Then Q is made orthonormal (QR) and rotated to Ritz vectors (Rayleigh-Ritz). That
is repeated until the residuals |V q - e q| certify the wanted pairs, or cannot fall further.

Defined results: a vector that is null or empty, or holds an entry that is null, not finite or too large
for a long integer is dropped, and so is one whose length is not the commonest (the greater of equally common
ones); an empty table gives no rows; rows that repeat an id or a vector are rows of their own; a component whose eigenvalue is
zero to rounding (equal vectors, fewer different vectors than components) has no direction: ``whitened`` is null and it is
left out of ``identity_error``; without any variance ``explained`` is null and ``identity_error`` 0; a
``deviation`` beyond a long integer is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens.llm.blocks import blocks, halves, scaled, stored_blocks, summed, total, unpack

COMPONENTS = 4
# Vectors that are iterated beyond the wanted ones, and the degree of the filter.
GUARD, DEGREE = 28, 10
# A Ritz pair is certified if its residual is below this share of the largest eigenvalue.
TOLERANCE = 1e-13
ROUNDS = 60
# An eigenvalue below this share of the largest is zero.
ZERO = 1e-12
SEED = 20240


class Covariance:
    """The covariance of stored blocks as an operator on thin matrices."""

    def __init__(self, held: DataFrame, d: int):
        self.held, self.d = held.select("n", "width", "x"), d

        def first(block: dict) -> list[int]:
            x = unpack(block)
            high, low = halves(x)
            return [block["n"], *(int(h) * 2**32 + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True))]

        found = total(self.held, first)
        self.n, self.sums = (found[0], found[1:]) if found else (0, [0] * d)
        # The mean as an integer and a fraction, so that centring loses nothing.
        self.whole = np.array([s // self.n for s in self.sums] if self.n else [0] * d, np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums] if self.n else [0.0] * d)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centre(x, self.whole, self.rest)

    def times(self, q: np.ndarray) -> np.ndarray:
        whole, rest = self.whole, self.rest

        def part(block: dict) -> np.ndarray:
            c = centre(unpack(block), whole, rest)
            return c.T @ (c @ q)

        return summed(self.held, part).reshape(q.shape) / self.n

    def trace(self) -> float:
        whole, rest = self.whole, self.rest
        return float(summed(self.held, lambda b: np.array([(centre(unpack(b), whole, rest) ** 2).sum()]))[0]) / self.n

    def spread(self, q: np.ndarray) -> np.ndarray:
        """The covariance of the projections on q, centred on their own mean before they are multiplied."""
        whole, rest = self.whole, self.rest
        mean = summed(self.held, lambda b: (centre(unpack(b), whole, rest) @ q).sum(axis=0)) / self.n

        def part(block: dict) -> np.ndarray:
            y = centre(unpack(block), whole, rest) @ q - mean
            return y.T @ y

        return summed(self.held, part).reshape(q.shape[1], -1) / self.n


def centre(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest


def filtered(times, q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of the operator, applied to q; small on 0 to cut. ``vq`` is the operator times q."""
    half = cut / 2
    if half <= ZERO * top:
        return vq  # nothing is left to damp
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (first / half)
    for _ in range(1, degree):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (after / half) * (times(now) - half * now) - sigma * after * before
        sigma = after
    return now


def eigenpairs(times, d: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the k largest eigenvalues of a symmetric operator without negative ones."""
    m = min(d, k + GUARD)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    best = None
    for turn in range(ROUNDS):
        vq = times(q)
        values, turned = np.linalg.eigh((lambda h: (h + h.T) / 2)(q.T @ vq))
        values, turned = values[::-1], turned[:, ::-1]
        q, vq = q @ turned, vq @ turned
        residuals = np.linalg.norm(vq - q * values, axis=0)[:k]
        worst, top = residuals.max(), values[0]
        done = best is not None and worst > best[3] / 2 and worst <= 1e-9 * top
        if best is None or worst < best[3]:
            best = values[:k], q[:, :k], residuals, worst
        # Certified, no longer falling because of rounding, a full basis, or no variance at all.
        if top <= 0 or worst <= TOLERANCE * top or done:
            break
        cut = max(values[-1], 0.0) if m < d else 0.0
        q = np.linalg.qr(filtered(times, q, vq, cut, top, DEGREE))[0]
    return best[:3]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    spark = table.sparkSession
    kind = dict(table.dtypes)[key]
    schema = f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = scaled(table, key, vector)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).where("d > 0")
    common = sizes.orderBy(F.desc("rows"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common.d
    rows = rows.where(F.size("x") == d)
    fit = stored_blocks(blocks(rows.select(F.lit(None).cast("int").alias("id"), "x").distinct()))
    cov = Covariance(fit, d)
    k = min(components, d)
    values, vectors, _ = eigenpairs(cov.times, d, k)
    trace = cov.trace()
    good = values > ZERO * max(values[0], 0.0) if values[0] > 0 else np.zeros(k, bool)
    scale = vectors[:, good] / np.sqrt(values[good])
    error = float(np.abs(cov.spread(scale) - np.eye(scale.shape[1])).max()) if good.any() else 0.0
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0.0)]
    n, sums, whole, rest = cov.n, cov.sums, cov.whole, cov.rest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            x = np.asarray(lists.flatten()).astype(np.int64).reshape(len(ids), d)
            y = np.full((len(ids), k), np.nan)
            y[:, good] = centre(x, whole, rest) @ scale
            values_ = y.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(len(ids)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(values_), n)),
                    pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    pa.array(values_, mask=np.isnan(values_)),
                    pa.array(explained * len(ids), pa.float64()),
                    pa.array(np.full(len(values_), error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("id", "x").mapInArrow(each, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sums of (n * x - S)^2, exact; None beyond a long integer."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest < 2**62 and x.shape[1] * largest**2 < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 2**63 else None for v in found]
