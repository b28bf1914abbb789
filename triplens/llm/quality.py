"""Quality rules as a short-circuit cascade: the rule that rejects most per cost runs first.

Base measures are taken of every text; a text that fails the base rules is rejected at once.
The other rules are ordered by (share rejected) / (seconds a row), both estimated on a hash
sample of rows, and chained in one CASE expression, whose later branches are evaluated only for
texts that all earlier rules let through. The order changes which rule is named as the first to
reject, and the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplens.llm.common import SPACES

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A reason to reject a text: a condition over the text and its base measures. Null does not reject."""

    name: str
    condition: Callable[[], Column]


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def _lines() -> Column:
    return F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1


# The ends of words of two or more final exclamation or question marks: each such word has one.
SHOUT = r"[!?]{2}([\x20\x09-\x0D]|$)"
LETTER_WORD = r"\p{L}[^\x20\x09-\x0D]*"
ELLIPSIS = r"(\.\.\.|\x{2026})(\n|$)"
BULLET = r"(^|\n)[-*\x{2022}]"

RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") > 20 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > _lines()),
    Rule("shouting", lambda: 2 * _count(SHOUT) > F.col("n_words")),
    Rule("no_letters", lambda: 10 * _count(LETTER_WORD) < 7 * F.col("n_words")),
    Rule("ellipsis", lambda: 10 * _count(ELLIPSIS) > 3 * _lines()),
    Rule("bullets", lambda: 10 * _count(BULLET) > 9 * _lines()),
)


def measures(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, the text and its base measures; a null text counts as no words.

    Words in repeated windows: the hashes of all three-word windows are sorted with their places,
    equal neighbours give the places of repeated windows, and the words these cover are counted.
    Texts whose windows all differ skip the sort.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*[F.col(c) for c in keep], body.alias("text"))
    split = base.select("*", F.array_remove(F.split("text", SPACES), "").alias("_w"))
    windows = F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))")
    hashed = split.select("*", F.size("_w").alias("_n"), F.when(F.size("_w") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    ordered = F.expr("sort_array(transform(_h, (h, i) -> struct(h, i)))")
    tied = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered)
    sorted_ = hashed.select("*", tied.alias("_s"))
    places = F.expr(
        """transform(filter(transform(_s, (x, i) -> struct(x.i as p,
             (i > 0 and _s[greatest(i - 1, 0)].h = x.h) or (i < size(_s) - 1 and _s[least(i + 1, size(_s) - 1)].h = x.h) as r)),
           x -> x.r), x -> x.p)"""
    )
    placed = sorted_.select("*", places.alias("_p"))
    covered = F.expr("size(array_distinct(concat(_p, transform(_p, p -> p + 1), transform(_p, p -> p + 2))))")
    lines = F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    found = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.expr("aggregate(_w, 0L, (a, w) -> a + char_length(w))").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    # A generator keeps later filters from being pushed into, and so repeating, these expressions.
    return placed.select(*keep, "text", F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def order_rules(measured: DataFrame, rules: Sequence[Rule] = RULES, share: int = 64, key: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) on a 1 in ``share`` hash sample, most rejection per cost first.

    Each rule runs alone over the sample; the sample is a share of the texts, so the estimate
    grows with the input and costs the same part of it at any size. Ties go by name.
    """
    sample = measured.where(F.pmod(F.xxhash64(key, F.lit("cascade")), F.lit(share)) == 0).where(~base_failed()).cache()
    total = sample.count()
    found = []
    for rule in rules:
        start = time.perf_counter()
        hits = sample.where(rule.condition()).count()
        found.append((rule, hits / total if total else 0.0, time.perf_counter() - start))
    sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-9), x[0].name))


def cascade(measured: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add base_failed, rejected_by (the first rule that rejects, or null) and kept."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.condition(), F.lit(rule.name))
    flagged = measured.select("*", base_failed().alias("base_failed"), verdict.alias("rejected_by"))
    return flagged.select("*", F.col("rejected_by").isNull().alias("kept"))
