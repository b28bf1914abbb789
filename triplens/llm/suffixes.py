"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in another text or the same one.

Positions. Sorting every byte's suffix would move many times the corpus, so suffixes are ranked at anchors: in every
window of ``WINDOW`` starts the one whose ``CONTEXT`` bytes hash least (the last of equal ones). Anchors depend on the bytes
around them alone, so equal strings have equal anchors inside. From an anchor to the next one, with the
next one's context, goes a phrase; an anchor's rank at level k is that of its next 2^k phrases.

Doubling. Level 0 ranks phrases by their 64-bit hashes. At offset 2^k Spark pairs each anchor's rank with that of the
anchor 2^k phrases on, sorts the pairs and ranks them anew; pairs that occur once drop out, and so do runs of phrases that are
longer than any that is asked for. A run of m phrases is named by the ranks of its first and its last 2^k, the largest power that fits.

Decision. Starts that share their first and last inner anchor are a range. Its inner run of phrases lies inside each of its
strings: if it occurs once, so do they. Its outer run covers them all: if it occurs twice, all of them do. For what is left
the byte strings are hashed, next to the inner run's rank, and counted; of starts that the outer run has settled only those of its
first occurrence take part, as the others are equal to it. Equal texts are one; each of them goes whole.

Equality rests on 64-bit hashes of phrases in runs of at least two, or on a hash of the string inside a class of equal inner runs.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows that repeat an id, or id
and text, are rows of their own (and repeat each other); ids may be null; an empty table gives no rows. A text is one row in
one task, however long; it is scanned in pieces. What is left of a text may not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplens.llm.common import released, small, stored

LENGTH = 400
WINDOW, CONTEXT = 96, 16
# Window starts that are looked at together, and rows of a unit of ranges or spans.
TOGETHER, UNIT = 1 << 21, 200_000
# Positions whose strings are hashed before they are handed on.
HASHED = 1 << 18

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW = np.uint64(0xFFFFFFFF)


def _chosen(data: np.ndarray, window: int) -> np.ndarray:
    """For each window of starts, the start with the least hash; the last of equal ones."""
    n = len(data) - CONTEXT + 1
    word = np.empty(n + 8, np.uint64)
    raw = data.tobytes()
    for k in range(8):
        word[k::8] = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)[: len(word[k::8])]
    h = word[:n] * _K[0] + word[8:] * _K[1]
    h ^= h >> np.uint64(32)
    h *= _K[2]
    # The least number has the least hash and of equal hashes the greatest place.
    least = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    return (_LOW - (least & _LOW)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first window start) of the anchors of texts that lie one after the other in ``data``."""
    ends = offsets[1:] - CONTEXT - window + 1  # the last start of a window inside each text
    found_a, found_s = [], []
    for low in range(0, len(data), TOGETHER):
        high = min(low + TOGETHER, len(data) - CONTEXT - window + 2)
        if high <= low:
            break
        sel = _chosen(data[low : high + window + CONTEXT - 2], window)
        starts = np.arange(low, low + len(sel))
        text = np.searchsorted(offsets, starts, side="right") - 1
        valid = starts <= ends[text]
        starts, sel = starts[valid], sel[valid] + low
        new = np.flatnonzero(np.r_[True, sel[1:] != sel[:-1]]) if len(sel) else np.empty(0, np.int64)
        found_a.append(sel[new])
        found_s.append(starts[new])
    a, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_s))
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
    a, s = a[new], s[new]
    return np.searchsorted(offsets, a, side="right") - 1, a, s


PHRASES = "node bigint, i int, a int, back int, gap int, next int, after int, h bigint"


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of (node, text): number, place, and by how much the anchor's first window lies before it, the next anchor
    and its first window after, and the first window of the one after that."""
    for batch in batches:
        nodes = np.asarray(batch.column(0))
        raw = batch.column(1).cast(pa.large_binary())
        if not len(raw):
            continue
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        text, a, s = anchors(data, offsets)
        follows = text[1:] == text[:-1]
        first = np.searchsorted(text, text)  # the first anchor of the same text
        number = np.arange(len(a)) - first
        stop = np.r_[s[1:], 0]
        last = np.r_[~follows, True][: len(a)]
        stop[last] = (offsets[1:] - CONTEXT - WINDOW + 2)[text[last]]
        at = np.flatnonzero(follows)
        view = memoryview(data)
        digest = xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(view[x:y]) for x, y in zip(a[at].tolist(), (a[at + 1] + CONTEXT).tolist(), strict=True)), np.uint64, len(at))
        place = a[at] - offsets[text[at]]
        columns = [number[at], place, a[at] - s[at], a[at + 1] - a[at], s[at + 1] - s[at], stop[at + 1] - s[at + 1]]
        arrays = [pa.array(nodes[text[at]]), *[pa.array(c.astype(np.int32)) for c in columns], pa.array(h.view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "i", "a", "back", "gap", "next", "after", "h"])


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name) of the keys that occur more than once, numbered in their order; the others are unique."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return stored(many.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("name")), "ranks")


def doubled(phrases: DataFrame, longest: int) -> list[DataFrame]:
    """(node, i, rank, bytes) at each level, of the anchors whose next 2^k phrases occur elsewhere; level 0 with the places."""
    classes = ranked(phrases, ["h"])
    now = phrases.join(classes, "h").select("node", "i", "a", "back", "gap", "next", "after", F.col("name").alias("rank"), F.col("gap").alias("bytes"))
    now = stored(now, "level")
    released(classes)
    levels = []
    while now.take(1):
        levels.append(now)
        # The anchor 2^k phrases on, if it is left: one shuffle by text, where a join would take two.
        offset = 2 ** (len(levels) - 1)
        onward = W.partitionBy("node").orderBy("i").rangeBetween(offset, offset)
        pairs = now.select("node", "i", "rank", "bytes", F.first(F.struct("rank", "bytes")).over(onward).alias("on")).where("on is not null")
        pairs = pairs.select("node", "i", "rank", F.col("on.rank").alias("then"), (F.col("bytes") + F.col("on.bytes")).alias("bytes"))
        pairs = stored(pairs.where(F.col("bytes") <= longest), "pairs")
        classes = ranked(pairs, ["rank", "then"])
        now = stored(pairs.join(classes, ["rank", "then"]).select("node", "i", F.col("name").alias("rank"), "bytes"), "level")
        released(pairs, classes)
    released(now)
    return levels


RANGES = "node bigint, p0 int, p1 int, im int, ia bigint, ib bigint, at int, om int, oa bigint, ob bigint"


def _ranges(levels: int):
    """The ranges of starts of the texts of a unit, each with the names of its inner run and, if it has one, its outer run."""
    inside = LENGTH - CONTEXT - WINDOW + 1  # from a start to the first start of its last window

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "i"], kind="stable")
        node, number = rows["node"].to_numpy(), rows["i"].to_numpy(np.int64)
        a, back, gap, next_, after = (rows[c].to_numpy(np.int64) for c in ("a", "back", "gap", "next", "after"))
        names = np.stack([rows[f"r{k}"].fillna(-1).to_numpy(np.int64) for k in range(levels)], axis=1)
        # A segment is a sequence of phrases without gap; it has one anchor more than phrases.
        new = np.r_[True, (node[1:] != node[:-1]) | (number[1:] != number[:-1] + 1)]
        segment = np.cumsum(new) - 1
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
        s = a - back
        # Segments lie one after the other on one axis, far enough apart.
        low, high = s[first], a[last] + gap[last]
        room = high - low + 4 * LENGTH
        shift = np.cumsum(room) - room - low
        anchor = np.insert(a + shift[segment], last + 1, a[last] + gap[last] + shift)
        start = np.insert(s + shift[segment], last + 1, s[last] + next_[last] + shift)
        stop = s[last] + next_[last] + after[last] + shift  # behind the last window of a segment's last anchor
        cuts = np.unique(np.r_[start, start - inside])
        at = np.searchsorted(start[first + np.arange(len(first))], cuts, side="right") - 1
        ok = (at >= 0) & (cuts + inside < stop[at])
        end = np.minimum(np.r_[cuts[1:], cuts[-1:] + 1], stop[at] - inside) - 1
        p0, p1, at = cuts[ok], end[ok], at[ok]

        def run(x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(phrases, name of the first 2^k, name of the last 2^k) of the runs from anchor x to y; 0 if one is unique."""
            m = np.where(valid, y - x, 0)
            k = np.frexp(np.maximum(m, 1).astype(np.float64))[1] - 1
            fits = valid & (k < levels)
            k = np.where(fits, k, 0)
            x, y = np.where(fits, x - at, 0), np.where(fits, y - at - (1 << k), 0)
            left, right = names[x, k], names[y, k]
            fits &= (left >= 0) & (right >= 0)
            return np.where(fits, m, 0).astype(np.int32), np.where(fits, left, -1), np.where(fits, right, -1)

        f = np.searchsorted(start, p0, side="right") - 1
        g = np.searchsorted(start, p0 + inside, side="right") - 1
        im, ia, ib = run(f, g, np.ones(len(f), bool))
        x = np.searchsorted(anchor, p0, side="right") - 1
        y = np.searchsorted(anchor, p1 + LENGTH - CONTEXT, side="left")
        begins = (first + np.arange(len(first)))[at]
        om, oa, ob = run(x, y, (x >= begins) & (y <= (last + 1 + np.arange(len(last)))[at]))
        place = anchor[np.maximum(x, 0)] - shift[at]
        out = pd.DataFrame({"node": node[first[at]], "p0": (p0 - shift[at]).astype(np.int32), "p1": (p1 - shift[at]).astype(np.int32), "im": im, "ia": ia, "ib": ib, "at": np.where(om > 0, place, -1).astype(np.int32), "om": om, "oa": oa, "ob": ob})
        return out[out["im"] > 0]

    return make


def by_unit(rows: DataFrame):
    """Rows grouped by units of about ``UNIT`` rows; a text is in one unit."""
    units = max(1, rows.count() // UNIT)
    return rows.withColumn("unit", F.pmod(F.xxhash64("node"), F.lit(units))).groupBy("unit")


def ranges(levels: list[DataFrame]) -> DataFrame:
    rows = levels[0].withColumnRenamed("rank", "r0")
    for k, level in enumerate(levels[1:], 1):
        rows = rows.join(level.select("node", "i", F.col("rank").alias(f"r{k}")), ["node", "i"], "left")
    rows = stored(rows.drop("bytes"), "anchors")
    out = stored(by_unit(rows).applyInPandas(_ranges(len(levels)), RANGES), "ranges")
    released(rows)
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, fp, node, p, open) of every start in the ranges of (node, text, ranges)."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for i in range(len(batch)):
            node, view = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
            asked = batch.column(2).slice(i, 1).flatten()
            p0, p1, cls, open_ = (np.asarray(asked.field(k).cast(pa.int64())) for k in range(4))
            counts = p1 - p0 + 1
            p = np.repeat(p0 - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            cls, open_ = np.repeat(cls, counts), np.repeat(open_, counts).astype(bool)
            for at in range(0, len(p), HASHED):
                own = p[at : at + HASHED]
                fp = np.fromiter((digest(view[x : x + LENGTH]) for x in own.tolist()), np.uint64, len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[at : at + HASHED]), pa.array(fp.view(np.int64)), pa.array(np.full(len(own), node)), pa.array(own.astype(np.int32)), pa.array(open_[at : at + HASHED])],
                    names=["cls", "fp", "node", "p", "open"],
                )


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The maximal runs of bytes that the strings starting from p0 to p1 cover, as two arrays for each text of a unit."""
    rows = rows.sort_values(["node", "p0"], kind="stable")
    node, p0, end = rows["node"].to_numpy(), rows["p0"].to_numpy(np.int64), rows["p1"].to_numpy(np.int64) + LENGTH
    new = np.r_[True, node[1:] != node[:-1]]
    text = np.cumsum(new) - 1
    # Texts lie one after the other on one axis.
    room = np.maximum.reduceat(end, np.flatnonzero(new)) + 1
    shift = (np.cumsum(room) - room)[text]
    reach = np.maximum.accumulate(end + shift)
    begins = np.flatnonzero(np.r_[True, (p0 + shift)[1:] > reach[:-1]])
    starts, ends = p0[begins], np.r_[reach[begins[1:] - 1], reach[-1]] - shift[begins]
    own = np.flatnonzero(np.r_[True, node[begins][1:] != node[begins][:-1]])[1:]
    return pd.DataFrame({"node": node[new], "starts": np.split(starts.astype(np.int32), own), "ends": np.split(ends.astype(np.int32), own)})


class Texts:
    """The different texts of documents that are long enough, each under a number; ``digests`` has (digest, node, copies)."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        self.long = self.rows.where(F.octet_length("text") >= LENGTH).select("key", "text", F.md5("text").alias("digest"))
        place = F.struct(F.col("key").isNull().alias("late"), "key")
        each = self.long.groupBy("digest", "key").agg(F.count("*").alias("n"))
        once = each.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "n")).alias("first"), F.sum("n").alias("copies"))
        self.digests = stored(once.select("digest", F.col("first.place.key").alias("first"), F.col("first.n").alias("again"), "copies", F.monotonically_increasing_id().alias("node")), "digests")

    def different(self) -> DataFrame:
        """(node, text), each text once: the row with its least id."""
        names = small(self.digests.select("node", "digest", "first", "again"))
        same = (F.col("own") == F.col("digest")) & F.col("key").eqNullSafe(F.col("first"))
        found = self.long.withColumnRenamed("digest", "own").join(names, same).select("node", "text", "again")
        out = found.where("again = 1").select("node", "text")
        # Rows that repeat both id and text.
        if self.digests.where("again > 1").take(1):
            out = out.unionByName(found.where("again > 1").select("node", "text").dropDuplicates(["node"]))
        return out


def repeated(texts: Texts) -> DataFrame:
    """(node, starts, ends): the maximal runs of bytes to remove from each different text, by the other texts and itself."""
    phrases = stored(texts.different().mapInArrow(_phrases, PHRASES), "phrases")
    # No run that is asked for is longer: a range, its strings, and an anchor's distance on either side.
    levels = doubled(phrases, LENGTH + 3 * WINDOW)
    released(phrases)
    if not levels:
        return phrases.sparkSession.createDataFrame([], "node bigint, starts array<int>, ends array<int>")
    found = ranges(levels)
    released(*levels)
    place, outer = F.struct("node", "at"), ["om", "oa", "ob"]
    twice = found.where("om > 0").groupBy(*outer).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select(*outer, "lo")
    twice = stored(twice, "outer")
    settled = found.join(twice, outer, "left").select("node", "p0", "p1", "im", "ia", "ib", F.col("lo").isNull().alias("open"), (place == F.col("lo")).alias("lead"))
    settled = stored(settled, "settled")
    released(found, twice)
    inner = ["im", "ia", "ib"]
    asking = settled.where("open or lead").groupBy(*inner).agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open")
    asking = stored(asking.select(*inner, F.monotonically_increasing_id().alias("cls")), "asking")
    asked = settled.where("open or lead").join(asking, inner).groupBy("node").agg(F.collect_list(F.struct("p0", "p1", "cls", F.col("open").cast("int").alias("open"))).alias("ranges"))
    asked = stored(asked, "asked")
    hashed = texts.different().join(small(asked, array="ranges"), "node").select("node", F.col("text").cast("binary").alias("text"), "ranges")
    hashed = stored(hashed.mapInArrow(_hashes, "cls bigint, fp bigint, node bigint, p int, open boolean"), "starts")
    released(asking, asked)
    equal = stored(hashed.groupBy("cls", "fp").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("cls", "fp"), "equal")
    last = hashed.where("open").join(equal, ["cls", "fp"], "left_semi").select("node", F.col("p").alias("p0"), F.col("p").alias("p1"))
    covers = stored(settled.where("not open").select("node", "p0", "p1").unionByName(last), "covers")
    released(hashed, equal, settled)
    spans = stored(by_unit(covers).applyInPandas(_merged, "node bigint, starts array<int>, ends array<int>"), "spans")
    released(covers)
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts = [], [[], [], []]
        for i in range(len(batch)):
            raw = batch.column(1)[i].as_buffer()
            n, whole = raw.size, batch.column(2)[i].as_py()
            starts, ends = ([0], [n]) if whole else (batch.column(3)[i].as_py() or [], batch.column(4)[i].as_py() or [])
            view = memoryview(raw)
            kept.append(b"".join(view[a:b] for a, b in zip([0, *ends], [*starts, n], strict=True)))
            for out, v in zip(counts, (n, n - len(kept[-1]), len(starts)), strict=True):
                out.append(v)
        columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the remaining bytes."""
    texts = Texts(docs, key, text)
    spans = repeated(texts)
    lost = texts.digests.select("digest", (F.col("copies") > 1).alias("whole"), "node").join(spans, "node", "left").where("whole or starts is not null")
    lost = stored(lost.select("digest", "whole", F.when(~F.col("whole"), F.col("starts")).alias("starts"), F.when(~F.col("whole"), F.col("ends")).alias("ends")), "lost")
    rows = texts.rows.withColumn("own", F.when(F.octet_length("text") >= LENGTH, F.md5("text")))
    joined = rows.join(small(lost.withColumnRenamed("digest", "own"), array="starts"), "own", "left")
    kind = dict(rows.dtypes)["key"]
    out = joined.select("key", F.col("text").cast("binary").alias("text"), "whole", "starts", "ends")
    out = out.mapInArrow(_cut, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("key", key)
