"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value theory.

A token is a word's first letters. Its weight is the log-odds of toxic against clean training
texts with an informative Dirichlet prior taken from the token's share of the whole corpus; a word
takes the stem (of ``STEMS`` letters) whose log-odds are most significant, and words without a
significant stem lower the sum by ``DRIFT``. One linear scan finds all maximal segments. In random
clean text the best of n tokens' segments scores about ln(K n) / lambda, where lambda solves
sum(p(s) exp(lambda s)) = 1 over the clean tokens' weights; the evidence of a text is the greatest
sum statistic of its r best segments over this. A logistic curve, fitted to the training texts'
evidence in bins, turns evidence into a score.

Labels are read of training rows only, those whose crc32 of the id modulo 4 is not 2. Counting
covers all texts and all training rows. The model that is sent to the tasks holds at most
``MAX_STEMS`` stems, the most significant.

Defined results: a null text is scored like an empty one, by the curve at no evidence; of labels
that repeat an id the greatest counts; null labels are none; without training rows of both kinds
every score is the share of toxic rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens.llm.common import small, stored

STEMS = (4, 5, 6, 7, 8)
PRIOR = 0.05
MIN_Z, MIN_ODDS = 3.5, 3.0
DRIFT = 0.1
K = 0.1
MAX_STEMS = 50_000
LOW, HIGH, BIN = -20.0, 60.0, 0.25
TRAINED_ON = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2"

_WORD = re.compile(r"[^\W_]+")


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled training rows."""
    kept = labels.where(TRAINED_ON).where("toxic is not null and doc_id is not null")
    return kept.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def stem_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, corpus, toxic, clean): in how many texts longest stems occur, over all texts."""
    longest = max(STEMS)
    cut = F.array_distinct(F.transform(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.substring(w, 1, longest)))
    rows = docs.where("text is not null").join(small(labels), "doc_id", "left").select("toxic", F.explode(cut).alias("stem")).where("stem != ''")
    return rows.groupBy("stem").agg(F.count("*").alias("corpus"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))


def log_odds(counts: DataFrame) -> DataFrame:
    """(stem, odds, z) of the significant stems of all lengths, from the counts of the longest."""
    kinds = F.array_distinct(F.array(*[F.substring("stem", 1, n) for n in STEMS]))
    stems = counts.select(F.explode(kinds).alias("stem"), "corpus", "toxic", "clean")
    stems = stems.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("corpus", "toxic", "clean")]).where("toxic > 0")
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("corpus", "toxic", "clean")]).first()
    # The prior counts as a share of the training tokens, spread over stems as the corpus is.
    out = stems
    for c in ("toxic", "clean"):
        share = F.lit(PRIOR * total[c] / max(total.corpus, 1.0))
        out = out.withColumn(f"y_{c}", F.col(c) + share * F.col("corpus"))
        out = out.withColumn(f"l_{c}", F.ln(F.col(f"y_{c}") / F.greatest(F.lit(total[c] * (1 + PRIOR)) - F.col(f"y_{c}"), F.lit(0.5))))
    out = out.where("y_clean > 0").select("stem", F.expr("l_toxic - l_clean").alias("odds"), F.expr("(l_toxic - l_clean) / sqrt(1 / y_toxic + 1 / y_clean)").alias("z"))
    return out.where(f"z >= {MIN_Z} and odds >= {MIN_ODDS}")


def weight_of(word: str, stems: dict[str, tuple[float, float]]) -> float:
    best = max((stems[s] for s in {word[:n] for n in STEMS} if s in stems), default=None)
    return best[1] if best else -DRIFT


def segments(positive: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal segments (score, first, last) of a text in which ``positive`` (place, weight) are
    the tokens of positive weight, in order, and all others weigh -DRIFT. Linear in the list's length."""
    held: list[list] = []  # sum before, sum after, first, last, and the nearest one held with a smaller sum before
    before, sum_ = -1, 0.0
    for place, weight in positive:
        sum_ -= DRIFT * (place - before - 1)
        now = [sum_, sum_ + weight, place, place, -1]
        sum_, before = sum_ + weight, place
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= now[0]:
                j = held[j][4]
            now[4] = j
            if j < 0 or held[j][1] >= now[1]:
                break
            now = [held[j][0], now[1], held[j][2], now[3], -1]
            del held[j:]
        held.append(now)
    return [(b - a, first, last) for a, b, first, last, _ in held]


def decay(weights: np.ndarray, counts: np.ndarray) -> float:
    """lambda: the positive root of sum(p exp(lambda s)) = 1, for a mean weight below zero."""
    p = counts / max(counts.sum(), 1e-9)
    if not (weights > 0).any() or (p * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * weights, 700))).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * weights, 700))).sum() < 1 else (low, mid)
    return high


def evidence(scores: list[float], n: int, rate: float) -> float:
    """The greatest sum statistic of the r best segments of a text of n tokens."""
    base = math.log(K * n + 1)
    best, sum_ = -base, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        sum_ += rate * s - base
        best = max(best, sum_ + math.lgamma(r + 1))
    return best


@dataclass(frozen=True)
class Model:
    stems: dict[str, tuple[float, float]]
    rate: float


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Stem weights and lambda. Counts stay in Spark; the chosen stems and a histogram of weights leave it."""
    counts = stored(stem_counts(docs, labels), "stems")
    chosen = log_odds(counts).orderBy(F.desc("z"), "stem").limit(MAX_STEMS).collect()
    stems = {r.stem: (r.z, r.odds) for r in chosen}

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"weight": [weight_of(w, stems) for w in b["stem"]], "n": b["clean"]})

    found = counts.select("stem", "clean").mapInPandas(weigh, "weight double, n bigint").groupBy("weight").agg(F.sum("n").alias("n")).orderBy("weight").collect()
    rate = decay(np.array([r.weight for r in found]), np.array([r.n + 0.5 * (r.weight > 0) for r in found], float)) if found else 1.0
    return Model(stems, rate)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, evidence, n_tokens, passages): every segment as start and end in characters, score and E-value."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for batch in batches:
            values, sizes, found = [], [], []
            for text in batch["text"]:
                low = text.lower()
                words = _WORD.findall(low)
                if len(known) > 1_000_000:
                    known.clear()
                hits = set()
                for w in set(words):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = weight_of(w, model.stems)
                    if x > 0:
                        hits.add(w)
                spans, n = [], len(words)
                if hits:
                    found_ = segments([(i, known[w]) for i, w in enumerate(words) if w in hits])
                    places = [m.span() for m in _WORD.finditer(low)]
                    spans = [{"start": places[a][0], "end": places[b][1], "score": s, "e_value": K * n * math.exp(-min(model.rate * s, 700.0))} for s, a, b in found_]
                values.append(evidence([s["score"] for s in spans], n, model.rate))
                sizes.append(n)
                found.append(spans)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "evidence": values, "n_tokens": sizes, "passages": found})

    schema = f"doc_id {kind}, evidence double, n_tokens bigint, passages array<struct<start: bigint, end: bigint, score: double, e_value: double>>"
    return rows.mapInPandas(scan, schema)


def curve(train: DataFrame) -> tuple[float, float]:
    """Intercept and slope of P(toxic) over the evidence, from counts in bins of the training rows."""
    at = F.floor(F.least(F.greatest(F.col("evidence"), F.lit(LOW)), F.lit(HIGH)) / BIN)
    bins = train.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).orderBy("bin").collect()
    x = np.array([(r.bin + 0.5) * BIN for r in bins])
    n, t = np.array([r.n for r in bins], float), np.array([r.t for r in bins], float)
    if not len(x) or t.sum() == 0 or t.sum() == n.sum():
        share = t.sum() / (n.sum() + 1) if len(x) else 0.0
        return math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], 1)
    for _ in range(60):  # Newton steps with a small ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (t - n * p) - np.array([0, 0.01]) * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01])
        step = np.linalg.solve(hessian, gradient)
        w = w + step / max(1.0, np.abs(step).max())
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, evidence, n_tokens, passages) of every document."""
    known = training_labels(labels)
    found = stored(passages(docs, fit(docs, known)), "passages")
    intercept, slope = curve(found.select("doc_id", "evidence").join(known, "doc_id"))
    p = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.least(F.greatest("evidence", F.lit(LOW)), F.lit(HIGH)))))
    held = F.coalesce(~F.expr(TRAINED_ON), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), p.alias("score"), "evidence", "n_tokens", "passages")
