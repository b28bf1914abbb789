from __future__ import annotations

import random

import numpy as np
import pytest

from triplens.llm import minhash as M

WORDS = [f"w{i}" for i in range(3000)]


def changed(words, n, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = r.choice(WORDS)
    return out


def some(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(5)
    elements = np.arange(300, dtype=np.uint64)
    a = r.random(300) * 4
    b = np.where(r.random(300) < 0.7, a, r.random(300) * 4)
    sig = M.signatures(np.concatenate([elements, elements]), np.concatenate([a, b]), np.array([300, 300]), 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signature_of_a_text_does_not_depend_on_its_neighbours():
    one, two = M.shingles(" ".join(some(700, 1))), M.shingles(" ".join(some(9, 2)))
    apart = [M.signatures(e, w.astype(float), np.array([len(e)]), 100)[0] for e, w in (one, two)]
    both = M.signatures(np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]).astype(float), np.array([len(one[0]), len(two[0])]), 100)
    assert (both[0] == apart[0]).all() and (both[1] == apart[1]).all()


def brute(rows):
    """Least id of each row's class by comparing all pairs."""
    sets = [M.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and M.similarity(sets[i], sets[j]) >= M.SIMILARITY:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            out[find(i)] = min(out.get(find(i), d), d)
    return [out.get(find(i)) for i in range(len(rows))]


def fixture():
    base = some(200, 10)
    rows = [(i, " ".join(some(120, 100 + i))) for i in range(20)]
    rows += [(100 + i, " ".join(changed(base, i % 7, i))) for i in range(60)]  # a cloud of near copies
    rows += [(200 + i, " ".join(base)) for i in range(40)]  # exact copies
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "two words"), (304, "two words"), (305, "one two three four five")]
    rows += [(None, " ".join(some(120, 100))), (400, rows[3][1]), (400, rows[3][1]), (None, "only here without id at all")]
    rows += [(500, " ".join(["again"] * 5000)), (501, " ".join(["again"] * 4500))]
    return rows


def test_classes_equal_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, class string, node int, component string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1) for r in M.near_duplicates(df).collect())
    want = sorted((d if d is not None else -1, c if c is not None else -1) for (d, _), c in zip(rows, brute(rows), strict=True))
    assert got == want


def test_one_row_of_each_class_stays(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, `class` int")
    out = M.first_of_classes(df)
    assert out.columns == df.columns
    kept = out.collect()
    without_words = [t for _, t in rows if not (t or "").split()]
    named = {c for (d, t), c in zip(rows, brute(rows), strict=True) if (t or "").split() and c is not None}
    assert len(kept) == len(named) + 1 + len(without_words)  # and the class without any id
    assert sorted(r.doc_id for r in kept if (r.text or "").split() and r.doc_id is not None) == sorted(named)


@pytest.mark.parametrize("call", [M.near_duplicates, M.first_of_classes])
def test_empty_table(spark, call):
    assert call(spark.createDataFrame([], "doc_id long, text string")).count() == 0
