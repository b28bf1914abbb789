"""Near-duplicate texts by DartMinHash signatures, banded joining and exact verification.

A text is a weighted set: its five-word shingles with their numbers of occurrences. Every unit of
an element's weight is a region into which darts are thrown; the darts of a region are a Poisson
number fixed by hashing the element, the unit of weight and the unit of rank, so equal elements of
two texts hold the same darts. Of the darts that fall on one coordinate of the signature the
earliest is kept. Two texts agree in a coordinate with their weighted Jaccard similarity as
probability. The cost is the length of the text plus the number of coordinates.

Defined results: a null or empty text has no shingle and is in a class of its own; a text of one to
four words has one shingle, all of it; equal texts are one class however many; rows that repeat a
document id are kept as rows; a class without any document id has a null class id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens.llm.common import Links, linked, small, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5

# Words of texts that are sketched together, to keep numpy's arrays long but bounded.
TOGETHER = 200_000

_U = np.uint64
# P(a Poisson number of mean 1 is at most i) as 64-bit limits, up to where it rounds to one.
_POISSON = np.array(
    [min(2**64 - 1, int(2**64 * float(p))) for p in np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, i + 1))) for i in range(18)])],
    dtype=np.uint64,
)
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look independent (the finalizer of SplitMix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each group of so many rows."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's n-word shingles, sorted, and how often each occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = min(n, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _ODD[i]
    return np.unique(mix(s), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k dart ids of each weighted set; the sets lie one after the other, ``sizes`` elements each.

    Darts are looked at in order of rank, a first range that should fill all coordinates and then
    ranges twice as long for the sets that still have an empty one. A dart of a later range could
    not be earlier than any that was found, so the signature does not depend on the ranges.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    units = np.maximum(np.ceil(weights), 1).astype(np.int64)
    level = _within(units)
    cells = mix(np.repeat(elements, units) ^ mix(level.astype(np.uint64)))
    limit = np.repeat(weights, units) - level
    owner = np.repeat(owner, units)
    total = np.bincount(owner, weights=np.minimum(limit, 1), minlength=n)
    best = np.zeros(n * k, np.uint64)
    low, high = np.zeros(n), k * (np.log(k) + 2) / np.maximum(total, 1e-9)
    active = total > 0
    while active.any():
        use = active[owner]
        cell, own, lim = cells[use], owner[use], limit[use]
        start = np.floor(low).astype(np.int64)
        times = (np.ceil(high).astype(np.int64) - start)[own]
        unit = _within(times) + np.repeat(start[own], times)
        seeds = mix(np.repeat(cell, times) + mix(unit.astype(np.uint64)))
        number = (seeds > _POISSON[0]).astype(np.int64) + (seeds > _POISSON[1]) + (seeds > _POISSON[2])
        many = seeds > _POISSON[3]
        number[many] = np.searchsorted(_POISSON, seeds[many], side="left")
        ids = mix(np.repeat(seeds, number) + _within(number).astype(np.uint64))
        own, unit, lim = np.repeat(np.repeat(own, times), number), np.repeat(unit, number), np.repeat(np.repeat(lim, times), number)
        rank = unit + (mix(ids ^ _U(1)) >> _U(11)) / 2.0**53
        take = (rank >= low[own]) & (rank < high[own])
        if (lim < 1).any():
            take &= (mix(ids ^ _U(2)) >> _U(11)) / 2.0**53 < lim
        ids, own, rank = ids[take], own[take], rank[take]
        at = own * k + (mix(ids ^ _U(3)) % _U(k)).astype(np.int64)
        empty = best[at] == 0
        ids, at, rank = ids[empty], at[empty], rank[empty]
        order = np.argsort(-rank, kind="stable")
        best[at[order]] = ids[order] | _U(1)  # of one coordinate's darts the last written, the earliest, stays
        active = active & (best.reshape(n, k) == 0).any(axis=1)
        low, high = high, high * 2
    return best.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per signature and band, different between bands."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = mix(key + parts[:, :, i])
    return key.view(np.int64)


def node_of(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(digest, bands) of the texts that have a word, once per batch."""

    def flush(nodes, sets):
        sizes = np.array([len(e) for e, _ in sets])
        found = signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64), sizes, BANDS * ROWS)
        return pd.DataFrame({"digest": nodes, "bands": list(band_keys(found))})

    for batch in batches:
        seen, nodes, sets, size = set(), [], [], 0
        for text in batch["text"]:
            node = node_of(text)
            if node in seen:
                continue
            seen.add(node)
            elements, weights = shingles(text)
            if len(elements):
                nodes.append(node)
                sets.append((elements, weights))
                size += len(elements)
            if size > TOGETHER:
                yield flush(nodes, sets)
                nodes, sets, size = [], [], 0
        if nodes:
            yield flush(nodes, sets)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets: dict[str, tuple] = {}
        keep = []
        for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
            for node, text in ((a, x), (b, y)):
                if node not in sets:
                    sets[node] = shingles(text)
            keep.append(similarity(sets[a], sets[b]) >= SIMILARITY)
        yield batch.loc[keep, ["a", "b"]]


def _shared_weight(left: list[tuple], right: list[tuple]) -> Iterator[np.ndarray]:
    """For each left set its similarity with every right set."""
    vocabulary, code = np.unique(np.concatenate([e for e, _ in right]), return_inverse=True)
    weights = np.concatenate([w for _, w in right])
    starts = np.cumsum([0, *[len(e) for e, _ in right]])[:-1]
    totals = np.add.reduceat(weights, starts)
    own = np.zeros(len(vocabulary), np.int64)
    for elements, weight in left:
        at = np.searchsorted(vocabulary, elements)
        at[at == len(vocabulary)] = 0
        here = vocabulary[at] == elements
        own[at[here]] = weight[here]
        both = np.add.reduceat(np.minimum(own[code], weights), starts)
        own[at[here]] = 0
        yield both / np.maximum(totals + int(weight.sum()) - both, 1)


def _across(group: pd.DataFrame) -> pd.DataFrame:
    """One link from each left text to each component of the right texts it is similar to."""
    left, right = group[group["left"]], group[~group["left"]]
    out: dict[tuple, tuple] = {}
    if len(left) and len(right):
        nodes, groups = right["node"].to_numpy(), right["component"].to_numpy()
        rows = _shared_weight([shingles(t) for t in left["text"]], [shingles(t) for t in right["text"]])
        for node, component, similar in zip(left["node"], left["component"], rows, strict=True):
            for k in np.nonzero((similar >= SIMILARITY) & (groups != component))[0]:
                out.setdefault((node, groups[k]), (node, nodes[k]))
    return pd.DataFrame({"a": [a for a, _ in out.values()], "b": [b for _, b in out.values()]}, dtype="int64")


LEFT, RIGHT = 128, 512


def near_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, component) of the texts that are linked to another; a digest is the MD5 of a text."""
    texts = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    nodes = texts.mapInPandas(_sketch, "digest string, bands array<bigint>").dropDuplicates(["digest"])
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "bands"), "signatures")
    members = nodes.select(F.explode("bands").alias("bucket"), "node")

    def prepare(ids: DataFrame) -> tuple[Links, Links]:
        wanted = stored(nodes.join(small(ids), "node", "left_semi").select("node", "digest"), "wanted")
        held = texts.select(F.md5("text").alias("digest"), "text").join(small(wanted), "digest")
        held = stored(held.select("node", "text").dropDuplicates(["node"]), "candidates")

        def is_link(pairs: DataFrame) -> DataFrame:
            x = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
            y = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
            both = pairs.join(y, "b").join(x, "a").select("a", "b", "text_a", "text_b")
            return both.mapInPandas(_similar, "a bigint, b bigint")

        def rest(members: DataFrame) -> DataFrame:
            """Every text outside its bucket's largest component against all others, in blocks."""
            counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
            main = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
            main = main.select("bucket", F.col("main.component").alias("main"), ((F.col("n") - F.col("main.n") + LEFT - 1) / LEFT).cast("int").alias("lefts"), ((F.col("n") + RIGHT - 1) / RIGHT).cast("int").alias("rights"))
            rows = members.join(main, "bucket")
            mine = F.xxhash64("node", "bucket")
            other = F.lit(0).cast("bigint")
            left = rows.where("component != main").select("bucket", "node", "component", F.lit(True).alias("left"), F.pmod(mine, "lefts").cast("bigint").alias("l"), F.explode(F.sequence(other, F.col("rights").cast("bigint") - 1)).alias("r"))
            right = rows.select("bucket", "node", "component", F.lit(False).alias("left"), F.explode(F.sequence(other, F.col("lefts").cast("bigint") - 1)).alias("l"), F.pmod(mine, "rights").cast("bigint").alias("r"))
            data = left.unionByName(right).join(held, "node")
            return data.groupBy("bucket", "l", "r").applyInPandas(_across, "a bigint, b bigint").distinct()

        return is_link, rest

    return nodes.select("node", "digest").join(linked(members, prepare), "node").select("digest", "component")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, class) of every row; a text without words has no class."""
    found = near_classes(docs, text).select("digest", F.col("component").cast("string").alias("component"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_words = F.translate(body, " \t\n\x0b\x0c\r", "") != ""
    rows = docs.select(F.col(key).alias("doc_id"), F.md5(body).alias("digest"), has_words.alias("_words"))
    # A class is named by its component, or by its text alone where nothing links to it.
    named = rows.join(small(stored(found, "near")), "digest", "left")
    return stored(named.select("doc_id", "digest", F.when(F.col("_words"), F.coalesce("component", "digest")).alias("class")), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept) per row: the least id of the row's class, and whether it is this row's.

    Rows that repeat both the least id and its text are all marked as kept; ``first_of_classes``
    leaves one of them.
    """
    named = classes(docs, key, text)
    first = named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("class_id"))
    out = named.where(F.col("class").isNotNull()).join(first, "class").select("doc_id", "class_id")
    alone = named.where(F.col("class").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return out.unionByName(alone).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def first_of_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns: the first by id (null last) and text; rows without words stay."""
    named = classes(docs, key, text).where(F.col("class").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"))
    first = named.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = stored(named.select("class", place.alias("place")).join(first, "class").select("place", "first").distinct(), "copies")
    lost = stored(rows.where("place != first").select(F.col("place.doc_id").alias("_doc"), F.col("place.digest").alias("_digest")), "lost")
    # A row that is first may itself be given several times.
    again = named.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
    again = stored(again, "again")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.md5(body).alias("_md5"))
    same = F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_md5") == F.col("_digest"))
    left = row.join(small(lost), same, "left_anti")
    again = small(again)
    once = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["_key", "_md5"]))
    return once.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
