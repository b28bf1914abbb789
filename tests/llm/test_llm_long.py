"""Long texts and clashing names."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from triplens.llm import bpe, html, lines, quality, tokens, toxicity


@pytest.mark.parametrize("run", [" " * 3000, "\n" * 2500, " \t" * 1500, "a" * 5000, "漢" * 4000, "😀" * 3000, "!" * 5000, "7" * 5000, "　" * 2000])
@pytest.mark.parametrize("around", [("", ""), ("word", "word"), ("x ", " y"), ("tail", "")])
def test_long_runs_have_the_tokens_of_the_pattern(run, around, monkeypatch):
    path, pattern = tokens.vocabulary()
    encoding, _ = tokens.load(path, pattern)
    text = around[0] + run + around[1]
    brute = [i for piece in regex.finditer(pattern, text) for i in encoding._encode_single_piece(piece.group().encode())]
    assert tokens.token_ids(text, encoding, pattern) == brute
    assert encoding.encode_ordinary(text) == brute  # short enough for the library itself


@pytest.mark.parametrize("unit", [" ", "\n", "a", "漢", "😀", "ab ", "é"])
def test_a_million_characters(spark, unit):
    df = spark.createDataFrame([(1, unit * (1_500_000 // len(unit)), "x")], "doc_id long, text string, key string")
    found = tokens.section_tokens(df.where("doc_id = 1"), *tokens.vocabulary(), starts=F.array(F.lit(0), F.lit(1000))).collect()
    assert len(found) == 2 and sum(r.n_tokens for r in found) > 0


def test_quality_and_segments_are_linear_on_long_texts(spark):
    text = " ".join(["wow!!"] * 300_000) + " " + "q" * 1_000_000 + "!! x!!\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    assert df.select(F.regexp_count("text", F.lit(quality.SHOUT)).alias("n")).first().n == 300_002
    assert time.perf_counter() - start < 20
    hits = [(60 * i, 4.0) for i in range(200_000)]
    start = time.perf_counter()
    assert len(toxicity.segments(hits)) == len(hits)
    assert time.perf_counter() - start < 5


def test_unsplit_million_equals_the_library(spark):
    path = bpe.vocabulary()
    text = "".join("abcdefghij"[(i * i + i // 7) % 10] for i in range(1_000_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = bpe.encode(df, path).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == bpe.load(path).encode(text, add_special_tokens=False).ids


def test_words_by_base_form_equal_the_library():
    path = bpe.vocabulary()
    made = bpe.load(path)
    for word in ("Word.", "don't.", "A.B.", "Don't", "é.", "É,", "ÀB!", "x..", "...", "ΣΑΣ.", "ſ.", "İ.", "á.", "5.", "O'Neil's.", "K."):
        base, mark = bpe.base_form(word)
        ids = [i for w in (base, mark) if w for i in made.encode(w, add_special_tokens=False).ids]
        assert ids == made.encode(word, add_special_tokens=False).ids, word


def test_line_dedup_with_clashing_names_and_repeated_ids(spark):
    line = "a line of some length that all of these documents share with one another"
    rows = [(7, f"{line}\n{hashlib.sha256(str(i).encode()).hexdigest()}", i, "g", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _lines string, base string")
    found = lines.dedup_lines(df, min_words=1)
    assert sorted(found.columns) == sorted(["doc_id", "text", "base", "_lines", "_gone"])
    kept = [r for r in found.collect() if line in r.text]
    assert len(kept) == 1
    own = {r.text.split("\n")[-1] for r in found.collect()}
    assert len(own) > 390


def test_pages_keep_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<article><p>Text of a page</p></article>", 5, 6)], "page_id long, url string, html string, page int, found int")
    (row,) = html.extract(pages, keep=("page", "found", "page_id", "url")).collect()
    assert row.text == "Text of a page" and (row.page, row.found, row.page_id) == (5, 6, 1)
