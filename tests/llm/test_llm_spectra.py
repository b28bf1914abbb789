"""Shallot search and whitening against brute force in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplens.llm import shallot, whitening

KIND = "vec_id long, embedding array<double>, label int, x int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "n") for i, v in rows], KIND).repartition(3)


def scaled(rows, length=None):
    """The usable rows as integers, by floor(256 * c)."""
    out = []
    for i, v in rows:
        if v is None or any(c is None or not np.isfinite(c) or abs(c) * 256 >= 2**63 for c in v) or (length and len(v) != length):
            continue
        out.append((i, [int(np.floor(256 * c)) for c in v]))
    return out


def k_means(rows, k, rounds):
    rows = sorted(scaled(rows, shallot.LENGTH), key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([r[1] for r in rows], object)
    c = [list(v) for v in x[:k]]
    for turn in range(rounds + 1):
        near = [min((int(((v - np.array(m, object)) ** 2).sum()), j) for j, m in enumerate(c)) for v in x]
        if turn < rounds:
            for j in range(len(c)):
                own = [v for v, (_, b) in zip(x, near, strict=True) if b == j]
                if own:
                    c[j] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    inertia = [sum(d for d, b in near if b == j) for j in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((r[0], b, d, inertia[b], sum(inertia), names[b]) for r, (d, b) in zip(rows, near, strict=True)), key=str)


def vectors(seed, n, spread=1.0, groups=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, 64)) * 2
    out = [(int(i), (centres[r.integers(groups)] + spread * r.normal(size=64)).tolist()) for i in range(n)]
    return out + [(n + i, out[i][1]) for i in range(20)]  # repeated vectors


@pytest.mark.parametrize(("seed", "spread", "k"), [(1, 1.0, 40), (2, 0.05, 40), (3, 3.0, 7), (4, 1.0, 1), (5, 0.0, 40)])
def test_clusters_equal_brute_force(spark, seed, spread, k):
    rows = vectors(seed, 300, spread)
    got = shallot.clusters(frame(spark, rows), k=k).collect()
    assert sorted(map(tuple, got), key=str) == k_means(rows, k, shallot.ROUNDS)


def test_clusters_of_odd_rows(spark):
    wide = vectors(7, 60)
    odd = [(None, wide[0][1]), (3, wide[9][1]), (3, wide[9][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [None] + [0.0] * 63)]
    odd += [(504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63), (506, [1e300] + [0.0] * 63), (507, [-0.0] * 64), (508, [1e9] * 64), (509, [-1e9] * 64)]
    rows = wide + odd
    got = shallot.clusters(frame(spark, rows), k=10).collect()
    want = [tuple(None if isinstance(v, int) and v >= 2**63 else v for v in r) for r in k_means(rows, 10, shallot.ROUNDS)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert shallot.clusters(frame(spark, [])).count() == 0
    few = frame(spark, wide[:3])
    assert sorted(r.cluster for r in shallot.clusters(few).collect()) == [0, 1, 2]


def whitened(rows, k=4):
    rows = scaled(rows)
    sizes = [len(x) for _, x in rows]
    d = max(set(sizes), key=lambda n: (sizes.count(n), n))
    rows = [(i, x) for i, x in rows if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in rows}), object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = np.array([s / n for s in sums])
    centred = fit.astype(float) - mean
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    out = {}
    for i, x in rows:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out.setdefault((i, tuple(x)), (deviation, (np.array(x, float) - mean) @ q / np.sqrt(np.maximum(values, 1e-300))))
    return n, values / np.trace(v), out, rows


@pytest.mark.parametrize("seed", [1, 2])
def test_whitening_equals_eigh(spark, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(400, 24)) @ np.diag(np.linspace(3, 0.5, 24)) + 5
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)] + [(9000 + i, base[i].tolist()) for i in range(50)]
    rows += [(None, base[3].tolist()), (1, base[4].tolist()), (8000, [1.0, 2.0]), (8001, None), (8002, []), (8003, [None] * 24), (8004, [float("nan")] * 24)]
    n, explained, want, kept = whitened(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * len(kept)
    sign = {}
    for g in sorted(got, key=lambda g: -abs(g.whitened)):
        options = [w for (i, _), w in want.items() if i == g.vec_id]
        near = min(abs(s * w[1][g.component - 1] - g.whitened) for w in options for s in ([sign[g.component]] if g.component in sign else [1, -1]))
        assert near < 1e-9
        if g.component not in sign and len(options) == 1:
            sign[g.component] = np.sign(options[0][1][g.component - 1] * g.whitened)
        assert g.deviation in [w[0] for w in options] and g.n == n
        assert abs(g.explained / explained[g.component - 1] - 1) < 1e-9 and g.identity_error < 1e-9


def test_whitening_of_flat_spectra_and_few_vectors(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0])] * 3)).collect()
    assert len(same) == 12 and all(r.whitened is None and r.explained is None and r.identity_error == 0 and r.deviation == 0 and r.n == 1 for r in same)
    two = whitening.whiten(frame(spark, [(1, [0.0, 0.0, 1.0]), (2, [0.0, 4.0, 1.0])])).collect()
    assert {(r.vec_id, r.component): None if r.whitened is None else round(abs(r.whitened), 9) for r in two} == {(i, c): 1.0 if c == 1 else None for i in (1, 2) for c in (1, 2, 3)}
    huge = whitening.whiten(frame(spark, [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 1.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id != 3)


def test_filter_needs_few_passes_where_the_gap_is_small():
    r = np.random.default_rng(0)
    q = np.linalg.qr(r.normal(size=(64, 64)))[0]
    v = q @ np.diag(np.r_[3.0, 2.9, 2.001, 2.0, np.linspace(1.99, 1.0, 60)]) @ q.T
    passes = [0]

    def times(x):
        passes[0] += 1
        return v @ x

    values, vectors_, residuals = whitening.eigenpairs(times, 64, 4)
    assert np.allclose(values, [3.0, 2.9, 2.001, 2.0], rtol=1e-12) and residuals.max() < 1e-12 * 3 and passes[0] < 150
    assert np.abs(np.abs((q[:, :4] * vectors_).sum(axis=0)) - 1).max() < 1e-9


def test_registered_whitening_keeps_every_row(spark, folder):
    from triplens.llm.queries import QUERIES

    out = QUERIES["op12_chebyshev_whitening"](spark, folder)
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert out.count() == 4 * n and out.agg(F.max("identity_error")).first()[0] < 1e-4
