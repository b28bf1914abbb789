"""Prefix doubling against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplens.llm import suffixes
from triplens.llm.queries import QUERIES


def brute(texts, length=suffixes.LENGTH):
    """(bytes, removed, spans, digest of the rest) of each text, from every string of the length."""
    data = [(t or "").encode() for t in texts]

    def key(d, p):
        return hashlib.blake2b(d[p : p + length], digest_size=12).digest()

    seen = Counter(key(d, p) for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for p in range(len(d) - length + 1):
            if seen[key(d, p)] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        kept = b"".join(d[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(d)], strict=True))
        out.append((len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, texts, ids=None, **extra):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(n, i, t) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "row int, doc_id bigint, text string")
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    found = suffixes.remove_repeats(docs)
    return sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect())


def expected(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return sorted((i is None, i, *b) for i, b in zip(ids, brute(texts), strict=True))


def words(r, n, vocabulary=3000):
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"word{r.randrange(vocabulary)}" for _ in range(n))


def made(seed):
    """Texts with planted repeats whose lengths lie around the limit, edits, copies, runs and periods."""
    r = random.Random(seed)
    texts = [words(r, r.randrange(1, 700)) for _ in range(40)]
    for _ in range(60):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        data = texts[i]
        n = r.choice([380, 395, 398, 399, 400, 401, 402, 405, 420, 500, 800])
        if len(data) > n:
            at = r.randrange(len(data) - n)
            k = r.randrange(len(texts[j]) + 1)
            texts[j] = texts[j][:k] + data[at : at + n] + texts[j][k:]
    for i in range(12):  # near copies: letters changed here and there
        t = list(texts[i])
        for _ in range(r.randrange(1, 5)):
            if t:
                t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [texts[3], texts[3], texts[5], None, "", "short", "a" * 399, "b" * 400, "c" * 401, "d" * 5000, "ab" * 3000, "abc" * 150]
    texts += ["".join(r.choice("ab") for _ in range(6000)), "é" * 1500, words(r, 30) * 20]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    texts = made(seed)
    assert result(spark, texts) == expected(texts)


def test_phrases_over_several_pieces_of_a_scan(spark, monkeypatch):
    r = random.Random(9)
    data = np.frombuffer(" ".join(words(r, 800) for _ in range(4)).encode(), np.uint8)
    offsets = np.array([0, 3000, 3500, 9000, len(data)])
    whole = suffixes.anchors(data, offsets)
    monkeypatch.setattr(suffixes, "TOGETHER", 1000)
    for a, b in zip(whole, suffixes.anchors(data, offsets), strict=True):
        assert (a == b).all()


def test_registered_query_equals_brute_force(spark, folder):
    found = QUERIES["op13_prefix_doubling"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *b) for d, b in zip(docs, brute([d.text for d in docs]), strict=True))
    assert sorted(map(tuple, found)) == want


def test_ids_and_columns(spark):
    r = random.Random(4)
    long = words(r, 300)
    texts = [long, long, long + "!", words(r, 200), None, words(r, 100) + long[:900], words(r, 90)]
    ids = [1, 1, None, 1, None, None, 7]
    assert result(spark, texts, ids, key="x", node=3, digest="d", own="o", whole=True, starts=None) == expected(texts, ids)


def test_empty_and_short_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [None, "", "x"]) == expected([None, "", "x"])
