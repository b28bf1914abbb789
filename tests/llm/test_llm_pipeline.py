"""Every stage of the pipeline against a plain computation on its own input."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.test_llm_minhash import brute
from triplens.llm import bpe, lines, mixing, quality
from triplens.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(120)
    out = [stored(docs, "input")]
    for name, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], folder), name))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "encode"]


def test_quality_keeps_what_no_rule_rejects(stages):
    want = {r.doc_id for r in quality.cascade(quality.measures(stages[0]), quality.RULES).where("kept").collect()}
    assert {r["doc_id"] for r in rows(stages[1])} == want and 0 < len(want) < stages[0].count()


def test_repeated_lines_stay_once(stages):
    before, after = rows(stages[1]), rows(stages[2])
    seen, exact = set(), {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        keep = []
        for raw in r["text"].split("\n"):
            norm = " ".join(w for w in raw.replace("\t", " ").split(" ") if w).lower()
            if len(norm.split(" ")) < lines.MIN_WORDS or norm not in seen:
                keep.append(raw)
            seen.add(norm)
        exact[r["doc_id"]] = keep
    for r in after:  # fuzzy copies may go beyond exact ones, in order
        left = iter(exact[r["doc_id"]])
        assert all(any(x == y for y in left) for x in r["text"].split("\n"))
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in after} >= {d for d, k in exact.items() if len([x for x in k if x.strip()]) == len(k) > 3 and d < 5}


def test_one_of_each_class_stays(stages):
    before = rows(stages[2])
    named = brute([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in rows(stages[3])} == set(named)


def test_mix_repeats_documents_as_budgeted(stages):
    copies = {r._row.doc_id: r.copies for r in mixing.mixed(stages[3]).collect()}
    got: dict[int, int] = {}
    for r in rows(stages[4]):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == copies


def test_encoding(stages):
    made = bpe.load(bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in rows(stages[4])}
    out = rows(stages[5])
    assert len(out) == stages[4].count()
    for r in out:
        ids = made.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded_sha256"] == hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_documents_table(spark, folder, stages):
    empty = stages[0].limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0
