"""Token counts of sections: whole documents are encoded once and token spans joined to sections.

A document is encoded as a whole, so its counts add up to what a model reads; encoding sections
apart would not. The tokens' byte lengths give their character spans, and each span is joined to
the sections it overlaps by binary search in the sections' starts. A token that crosses a boundary
goes by an explicit rule:

- ``most``: to the section that holds most of its characters, the earliest of equals (default);
- ``start``: to the section of its first character;
- ``share``: to all its sections, in proportion to their characters.

Sections are given by their starts, which ascend from 0 and cut the whole text; without them they
are the lines, each with its line feed. A character split between two tokens counts for both.

Defined results: a null or empty text has one section, 0 to 0, without tokens; an empty section
(a start that repeats) has none; rows that repeat an id are rows of their own. Texts may be of any length and hold runs of
any length without a break.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("most", "start", "share")
# Output rows that are handed on together.
TOGETHER = 50_000


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """The rank file and the pattern that splits text before merging."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


# Runs of white space from this length on are merged without the pattern, whose search is bounded.
LONG_RUN = 1000
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)


def token_ids(text: str, encoding, pattern: str) -> list[int]:
    """The ids of a whole text.

    The pattern takes a run of white space but its last character, or all of it at the text's end, as one piece; no other piece
    goes on into white space. So the text may be cut there, and a long run is merged as the piece it is. Should the library
    still give up on a text, the pieces are found here and merged one by one.
    """
    ids, at = [], 0
    try:
        for run in _RUN.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            ids += encoding.encode_ordinary(text[at : run.start()])
            ids += encoding._encode_single_piece(text[run.start() : stop].encode("utf-8"))
            at = stop
        return ids + encoding.encode_ordinary(text[at:])
    except BaseException as e:  # the library's panics are no ordinary exceptions
        if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
            raise
        return [i for piece in regex.finditer(pattern, text) for i in encoding._encode_single_piece(piece.group().encode("utf-8"))]


def spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token of a text."""
    encoding, lengths = load(path, pattern)
    ids = np.array(token_ids(text, encoding, pattern), np.int64)
    ends = np.cumsum(lengths[ids])
    if len(text) == (ends[-1] if len(ends) else 0):
        return ends - lengths[ids], ends
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80)  # of the character a byte belongs to, from 1
    return number[ends - lengths[ids]] - 1, number[ends - 1]


def line_starts(text: str) -> np.ndarray:
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, np.int64)


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, length: int, rule: str) -> np.ndarray:
    """Tokens of each section."""
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last - 1, "right") - 1
    out = np.bincount(a[a == b], minlength=n).astype(np.float64)
    ends = np.append(starts[1:], length)
    for s, e, i, j in zip(first[a < b], last[a < b], a[a < b], b[a < b], strict=True):
        if rule == "start":
            out[i] += 1
            continue
        held = np.minimum(ends[i : j + 1], e) - np.maximum(starts[i : j + 1], s)
        if rule == "most":
            out[i + int(held.argmax())] += 1
        else:
            out[i : j + 1] += held / held.sum()
    return out


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "most", key: str = "doc_id", text: str = "text", starts: Column | None = None) -> DataFrame:
    """(key, section, start, end, n_tokens) of every section of every row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    given = F.lit(None).cast("array<bigint>") if starts is None else starts.cast("array<bigint>")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), given.alias("starts"))
    kind = dict(rows.dtypes)["key"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns, size = [], [[], [], [], []], 0
            keys, texts, bounds = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (t, given_) in enumerate(zip(texts, bounds, strict=True)):
                begin = line_starts(t) if not given_ else np.array(given_, np.int64)
                found = attribute(*spans(t, path, pattern), begin, len(t), rule) if t else np.zeros(len(begin))
                at.append(np.full(len(begin), i))
                for column, value in zip(columns, (np.arange(len(begin)), begin, np.append(begin[1:], len(t)), found), strict=True):
                    column.append(value)
                size += len(begin)
                if size > TOGETHER or i + 1 == len(texts):
                    arrays = [pa.array(np.concatenate(c)) for c in columns]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(at))), *arrays], names=["key", "section", "start", "end", "n_tokens"])
                    at, columns, size = [], [[], [], [], []], 0

    out = rows.mapInArrow(count, f"key {kind}, section bigint, start bigint, end bigint, n_tokens double")
    return out.withColumnRenamed("key", key)
