"""BPE encoding and decoding with whole texts cut in halves and rejoined exactly.

A text longer than ``PIECE`` characters is halved again and again, at the middle and not at a word
end, and the pieces are encoded in parallel as rows of their own. Neighbours are then joined up a
tree. Around each join a window of text is encoded again; it grows until on either side it agrees
with the piece on two tokens in a row, ids and places. Two tokens that stand side by side in a
valid encoding stand so in any text that has them there, so between such pairs the window's tokens
and beyond them the pieces' tokens are those of the whole text. A window that has grown over both
pieces is their encoding.

White space always ends a word for the tokenizer, so texts and pieces are encoded word by word, and each
worker remembers the words it has met; a word of more than ``WORD`` characters is encoded
as it comes and not remembered.

Defined results: a null text is encoded as the empty one, which has no tokens; rows that repeat
an id are rows of their own; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 15
WINDOW = 64
WORD = 64
REMEMBERED = 250_000
# Bytes of text that are encoded before their rows are handed on.
TOGETHER = 4_000_000

# What Unicode calls white space, as Python's and as Arrow's patterns write it.
_WORDS = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=8)
def _memory(path: str, places: bool = False) -> dict:
    return {}


def decode(path: str, ids: np.ndarray) -> str:
    return load(path).decode(ids.tolist(), skip_special_tokens=False)


def base_form(word: str) -> tuple[str, str]:
    """(word, mark) whose tokens, one after the other, are those of the word.

    Letters and marks are never in one token, and the vocabulary is in lower case: so a mark behind a plain letter can be
    taken off and plain capitals lowered. Other words stay as they are.
    """
    mark = ""
    if len(word) > 1 and word[-1] in ".,;:!?" and word[-2] < "\u0100" and word[-2].isalpha():
        word, mark = word[:-1], word[-1]
    return (word.lower() if word.isascii() else word), mark


@lru_cache(maxsize=4)
def _plain_case(path: str) -> bool:
    """Whether words may be brought to their base form: the tokenizer lowers letters and keeps them apart from marks."""
    ids = [load(path).encode(t, add_special_tokens=False).ids for t in ("Word.", "word", ".")]
    return ids[0] == ids[1] + ids[2]


def remember(path: str, words: list[str], places: bool = False) -> dict:
    """Word -> ids as bytes, or ids, starts and ends in turn; words that are not yet known are encoded in one batch.

    A memory that has grown too large keeps the words that are asked for now.
    """
    known, made = _memory(path, places), load(path)
    new = [w for w in words if w not in known]
    if not new:
        return known
    extra = {}
    for w, e in zip(new, (made.encode_batch if places else made.encode_batch_fast)(new, add_special_tokens=False), strict=True):
        found = array("I", [v for i, (a, b) in zip(e.ids, e.offsets, strict=True) for v in (i, a, b)] if places else e.ids).tobytes()
        (known if len(w) <= WORD else extra)[w] = found
    out = {**known, **extra} if extra else known
    if len(known) > REMEMBERED:
        now = {w: known[w] for w in words if w in known}
        out = {**now, **extra}
        known.clear()
        known.update(now)
    return out


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and where each text's begin and the last one's end."""
    split = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_string()), _SPACES, " "), " ")
    words, stops = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[stops - stops[0]]


def encode_words(path: str, texts: pa.Array) -> tuple[list[bytes], list[str]]:
    """The ids of texts as little-endian 32-bit integers, and their decoded texts, word by word.

    The different words of all texts are looked up once; their ids are then laid out by number. A vocabulary without
    a decoder decodes to its tokens with spaces between; with one, texts are decoded one by one.
    """
    if not len(texts):
        return [], []
    words, stops = cut_words(texts)
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    if _plain_case(path):
        forms = [base_form(w) for w in names]
        known = remember(path, list(dict.fromkeys(w for form in forms for w in form if w)))
        found = [known[w] + known[mark] if mark else known[w] for w, mark in forms]
    else:
        known = remember(path, names)
        found = [known[w] for w in names]
    at = np.asarray(coded.indices)
    # The ids of the different words lie one after the other; each occurrence copies its word's part.
    pool = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begins = np.cumsum(sizes) - sizes
    own = sizes[at]
    ends = np.cumsum(own)
    ids = pool[np.repeat(begins[at] - (ends - own), own) + np.arange(int(own.sum()))]
    cuts = np.concatenate([[0], ends])[stops]
    if load(path).decoder is None:
        shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), _tokens(path).take(pa.array(ids))), " ").to_pylist()
    else:
        shown = [decode(path, ids[x:y]) for x, y in zip(cuts, cuts[1:])]
    return [ids[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], shown


@lru_cache(maxsize=4)
def _tokens(path: str) -> pa.Array:
    made = load(path)
    return pa.array([made.id_to_token(i) for i in range(made.get_vocab_size())], pa.string())


def spans(path: str, text: str) -> np.ndarray:
    """Rows (id, start, end) of the tokens of a text as it stands."""
    e = load(path).encode(text, add_special_tokens=False)
    return np.column_stack([np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)])


def piece_spans(path: str, text: str) -> np.ndarray:
    """The same, word by word: a text of many words meets most of them again and again."""
    words = [(m.start(), m.group()) for m in _WORDS.finditer(text)]
    if sum(len(w) > WORD for _, w in words) * WORD > len(text) // 2:
        return spans(path, text)
    known = remember(path, list(dict.fromkeys(w for _, w in words)), places=True)
    found = [known[w] for _, w in words]
    out = np.frombuffer(b"".join(found), "<u4").astype(np.int64).reshape(-1, 3)
    if len(words):
        out[:, 1:] += np.repeat(np.array([at for at, _ in words], np.int64), [len(f) // 12 for f in found])[:, None]
    return out


def _pairs(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows (end of the first, its id and start, id, start and end of the second) of neighbouring tokens between low and high."""
    tokens = tokens[(tokens[:, 1] >= low) & (tokens[:, 2] <= high)]
    a, b = tokens[:-1], tokens[1:]
    a, b = (x[(a[:, 2] <= b[:, 1]) & (a[:, 1] < a[:, 2])] for x in (a, b))
    return np.column_stack([a[:, 2], a[:, :2], b])


def _meet(x: np.ndarray, y: np.ndarray, low: int, high: int) -> int | None:
    """A place between low and high before and after which both have the same token, or None."""
    right = set(map(tuple, _pairs(y, low, high).tolist()))
    same = [p[0] for p in _pairs(x, low, high).tolist() if tuple(p) in right]
    return same[len(same) // 2] if same else None


def join(path: str, text: str, base: int, cut: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The tokens of a text from those of its parts before and after ``cut``. All places count from ``base``, the text's start."""
    width = WINDOW
    while True:
        low, high = max(base, cut - width), min(base + len(text), cut + width)
        window = spans(path, text[low - base : high - base]) + np.array([0, low, low])
        start = base if low == base else _meet(left, window, low, cut)
        end = base + len(text) if high == base + len(text) else _meet(window, right, cut, high)
        if start is not None and end is not None:
            a, b = window[:, 1], window[:, 2]
            inner = window[(start <= a) & (b <= end) & ((a < b) | (start < b))]
            return np.concatenate([left[left[:, 2] <= start], inner, right[end <= right[:, 1]]])
        width *= 2


def concatenate(path: str, text: str, pieces: list[np.ndarray], cuts: list[int]) -> np.ndarray:
    """Join the pieces of a text in pairs until one is left. ``cuts`` are the places between them."""
    starts = [0, *cuts]
    parts = [(s, e, p + np.array([0, s, s])) for s, e, p in zip(starts, [*cuts, len(text)], pieces, strict=True)]
    while len(parts) > 1:
        out = [(s, e, join(path, text[s:e], s, m, x, y)) for (s, m, x), (_, e, y) in zip(parts[::2], parts[1::2])]
        parts = out + parts[len(parts) - len(parts) % 2 :]
    return parts[0][2]


OUT = "ids binary, n_tokens bigint, decoded string"


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_tokens, decoded) of every row; ``ids`` are little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            upto = np.cumsum(np.asarray(pc.binary_length(texts)))
            start = 0
            while start < len(texts):
                # At least one text, and no more than about TOGETHER bytes.
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TOGETHER)))
                ids, shown = encode_words(path, texts.slice(start, stop - start))
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, stop - start), pa.array(ids, pa.binary()), sizes, pa.array(shown, pa.string())], names=["key", "ids", "n_tokens", "decoded"]
                )
                start = stop

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [piece_spans(path, t).astype(np.int32) for t in batch["text"]]
            for i, name in enumerate(("id", "start", "end")):
                batch[name] = [f[:, i].copy() for f in found]
            yield batch

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        parts = [np.column_stack([a, b, c]).astype(np.int64).reshape(-1, 3) for a, b, c in zip(group["id"], group["start"], group["end"], strict=True)]
        cuts = np.cumsum([len(t) for t in group["text"]])[:-1].tolist()
        ids = concatenate(path, "".join(group["text"]), parts, cuts)[:, 0].astype("<u4")
        return pd.DataFrame({"node": [group["node"].iloc[0]], "ids": [ids.tobytes()], "n_tokens": [len(ids)], "decoded": [decode(path, ids)]})

    out = rows.where(F.length("text") <= PIECE).mapInArrow(short, f"key {kind}, {OUT}")
    long = rows.where(F.length("text") > PIECE).select("key", F.md5("text").alias("node"), "text")
    # Halving until no part is longer than PIECE.
    number = F.expr(f"cast(power(2, ceil(log2(length(text) / {PIECE}))) as int)")
    once = long.dropDuplicates(["node"]).select("node", "text", number.alias("n"))
    cut = F.expr(
        "transform(sequence(0, n - 1), i -> substring(text, cast(i * cast(length(text) as bigint) div n as int) + 1,"
        " cast((i + 1) * cast(length(text) as bigint) div n as int) - cast(i * cast(length(text) as bigint) div n as int)))"
    )
    # Pieces cost time, not bytes: they are dealt to as many tasks as the session has, whatever their size.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = once.select("node", F.posexplode(cut).alias("piece", "text")).repartition(tasks, "node", "piece")
    encoded = parts.mapInPandas(pieces, "node string, piece int, text string, id array<int>, start array<int>, end array<int>")
    joined = encoded.groupBy("node").applyInPandas(whole, f"node string, {OUT}")
    return out.unionByName(long.select("key", "node").join(joined, "node").drop("node")).withColumnRenamed("key", key)
