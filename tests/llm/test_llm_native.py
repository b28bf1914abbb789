"""Quality rules, shards, mixing and lines on hand-made rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from triplens.llm import common, lines, mixing, quality, queries, shards

LONG = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(6))
NASTY = [None, "", " \n\t ", "a", LONG, LONG, "x\x0by\x0cz\rw", "é ü   b", "a b c " * 40, "line one here\n" * 30, "w " * 3000]


def frame(spark, texts, extra="kept boolean, size int, n_words int"):
    return spark.createDataFrame([(i, t, True, 1, 2) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_base_measures_equal_brute_force(spark):
    rows = {r.doc_id: r for r in quality.measures(frame(spark, NASTY)).collect()}
    for i, t in enumerate(NASTY):
        w, ls = words(t), [x for x in (t or "").split("\n") if words(x)]
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = rows[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i


def test_rule_order_does_not_change_verdicts(spark):
    bad = [" ".join(["WOW!!"] * 20 + [f"w{i}" for i in range(35)]), " ".join(f"w{i} |" for i in range(60)), LONG + "\n" + "\n".join(["same line of words"] * 20)]
    measured = quality.measures(frame(spark, NASTY + bad))
    a = {r.doc_id: r.kept for r in quality.cascade(measured, quality.RULES).collect()}
    b = {r.doc_id: r.kept for r in quality.cascade(measured, quality.RULES[::-1]).collect()}
    assert a == b and a[4] and not any(a[len(NASTY) + i] for i in range(1, 3))
    ordered = quality.order_rules(measured, share=1)
    assert [x[1] / x[2] for x in ordered] == sorted((x[1] / x[2] for x in ordered), reverse=True)


def test_shards_are_gapless_and_grow_into_the_new_one(spark):
    rows = [(i % 400 if i % 3 else None, NASTY[i % len(NASTY)]) for i in range(1200)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text").collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, shards.SHARDS)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert want == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out)


def test_a_key_of_many_rows_is_cut_into_chunks(spark):
    rows = [(None if i % 3 == 0 else i, "x" * (i % 50) + str(i)) for i in range(6000)]
    rows += [(7, "y" * (i % 40) + str(i)) for i in range(800)] + [(None, "same")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    assert set(shards.hot_keys(name, docs, 20)) == {hashlib.md5(b"7").hexdigest(), hashlib.md5(b"null").hexdigest()}
    placed = docs.select(F.md5(name).alias("_order"), (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"))
    out = shards.chunked(placed, shards.hot_keys(name, docs, 20), 31).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter(r._chunk for r in out)
    assert max(sizes.values()) < 400
    # Chunks follow the order: sorted by the order, they never go down.
    chunks = [r._chunk for r in sorted(out, key=lambda r: (r._order, r.size, r.text_crc32))]
    assert chunks == sorted(chunks)


def test_slots_of_a_key_of_many_rows(spark):
    rows = [(None, f"{i}" * (i % 9 + 1)) for i in range(900)] + [(i, f"t{i}") for i in range(1500)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = {}
    for r in out:
        name = "null" if r.doc_id is None else str(r.doc_id)
        by.setdefault(r.shard, []).append((r.slot, (hashlib.md5(name.encode()).hexdigest(), r.size, r.text_crc32)))
    for slots in by.values():
        slots.sort()
        assert [s for s, _ in slots] == list(range(len(slots)))
        assert [o for _, o in slots] == sorted(o for _, o in slots)


def test_weights_set_the_shares_and_few_keys_move(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"))
    one = keys.select("doc_id", shards.shard_of(F.col("doc_id"), [1.0, 3.0]).alias("s"))
    assert abs(one.where("s = 1").count() / 20000 - 0.75) < 0.02
    two = one.withColumn("t", shards.shard_of(F.col("doc_id"), [1.0, 3.0, 1.0]))
    assert two.where("s != t and t != 2").count() == 0
    assert abs(two.where("s != t").count() / 20000 - 0.2) < 0.02


def fill(children, total):
    """Water level of (weight, cap, name) in whole tokens."""
    full, left = {}, sorted(children, key=lambda c: (c[1] / c[0], c[2]))
    rest = total
    while left and left[0][1] * sum(c[0] for c in left) <= left[0][0] * rest:
        full[left[0][2]] = left[0][1]
        rest -= left.pop(0)[1]
    w = sum(c[0] for c in left)
    return full | {n: weight * rest // w for weight, _, n in left}


def test_mixing_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["t"] * r.randrange(0, 40)), r.choice(["en", "de", "xx", None]), r.choice(["src0", "src1", "src9", "src15", "odd", None])) for i in range(500)]
    rows += [(None, "same text", "en", "src0"), (None, None, "en", "src0"), (7, "given twice", "en", "src0"), (7, "given twice", "en", "src0")]
    rows += [(900 + i, "t t t", "fr", "src3") for i in range(3)]
    mix = mixing.Mix(budget_percent=60)
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), mix)
    copies = collections.Counter()
    for x in got.collect():
        copies[(x._row.doc_id, x._row.text)] = x.copies
    leaf = collections.defaultdict(list)
    for d, t, la, s in rows:
        domain = next((k for k, v in mix.domains.items() if s in v), "other")
        n = len((t or "").split())
        if n:
            leaf[(domain, la or "other", s or "other")].append((d, t, n))
    tokens = {k: sum(n for *_, n in v) for k, v in leaf.items()}
    cap = lambda *k: mix.max_epochs * sum(v for q, v in tokens.items() if q[: len(k)] == k)
    want = collections.Counter()
    top = fill([(mix.domain_weights.get(d, 5), cap(d), d) for d in {k[0] for k in tokens}], sum(tokens.values()) * 60 // 100)
    for d, b in top.items():
        mid = fill([(mix.lang_weights.get(x, 5), cap(d, x), x) for x in {k[1] for k in tokens if k[0] == d}], b)
        for la, c in mid.items():
            for s, e in fill([(5, cap(d, la, x), x) for x in {k[2] for k in tokens if k[:2] == (d, la)}], c).items():
                key = (d, la, s)
                epochs, rest = divmod(e, tokens[key])
                units = collections.defaultdict(list)
                for doc in leaf[key]:
                    name = str(doc[0]) if doc[0] is not None else "text " + hashlib.md5(doc[1].encode()).hexdigest()
                    units[hashlib.md5(f"{mix.seed}|{epochs}|{name}".encode()).hexdigest()].append(doc)
                used = 0
                for h in sorted(units):
                    used += sum(n for *_, n in units[h])
                    for doc in units[h]:
                        if epochs + (used <= rest):
                            want[doc[:2]] = epochs + (used <= rest)
    assert copies == want


@pytest.mark.parametrize("call", [quality.measures, shards.assign, lambda d: mixing.mixed(d), lambda d: lines.dedup_lines(d)])
def test_empty_table(spark, call):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert call(empty).count() == 0


def line(i, n=20):
    r = random.Random(i)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randrange(50)) for _ in range(n))


def test_lines_keep_the_first_of_each_group(spark):
    long = line(99, 400)
    near = long.replace("alpha", "alpho", 1)
    rows = [
        (3, f"{line(1)}\n\nshort line\n{line(2)}"),
        (1, f"{line(2).upper()}  \n{long}"),
        (2, f"{near}\nshort line\n{line(3)}"),
        (2, f"{near}\nshort line\n{line(3)}"),
        (None, line(3)),
        (4, None),
        (5, ""),
        (6, f"{line(4)}\n{line(4)}"),
    ]
    df = spark.createDataFrame([(d, t, 5, True) for d, t in rows], "doc_id long, text string, line int, hash boolean")
    out = lines.dedup_lines(df)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(3, f"{line(1)}\n\nshort line"), (1, rows[1][1]), (2, f"short line\n{line(3)}"), (2, f"short line\n{line(3)}"), (None, ""), (4, None), (5, ""), (6, line(4))]
    assert got == sorted(want, key=str)
    assert out.columns[:4] == df.columns


def test_simhash_equals_brute_force(spark):
    texts = [line(1), "a a a b c", line(5, 200), " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(700)), " ".join(f"w{i}" for i in range(70_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, norm string")
    got = {r.i: r.sim for r in df.select("i", lines.simhash("norm").alias("sim")).collect()}
    words = df.select("i", F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).select("i", F.xxhash64("w").alias("h")).collect()
    for i in range(len(texts)):
        hashes = [r.h for r in words if r.i == i]
        assert got[i] == sum(1 << b for b in range(lines.BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def touched(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        at = r.randrange(len(out[i]))
        out[i] = out[i][:at] + r.choice("qxz") + out[i][at + 1 :]
    return " ".join(out)


def test_near_lines_are_found_at_every_length(spark):
    """Share of the pairs of a brute-force edit-similarity join that end in one group, by words a line."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    rows = []
    for n in (5, 8, 12, 20, 30, 60, 100):
        for i in range(60):
            words = [r.choice(vocabulary) for _ in range(n)]
            rows += [(len(rows), n, " ".join(words)), (len(rows) + 1, n, touched(r, words, 1 if i % 2 else max(1, n // 10)))]
    wide = "".join(chr(0x4E00 + i * 7) for i in range(60))  # a line without spaces, among five words
    rows += [(len(rows), 0, f"a b c d {wide}"), (len(rows) + 1, 0, f"a b c d {wide[:30]}x{wide[31:]}")]
    df = spark.createDataFrame(rows, "doc_id long, n int, text string")
    a, b = (df.select(F.col("doc_id").alias(x), F.col("text").alias("t" + x), "n") for x in "ab")
    near = a.join(b, "n").where("a < b and levenshtein(ta, tb, cast(floor(greatest(length(ta), length(tb)) * 0.1D) as int)) >= 0")
    gone = {x.doc_id for x in lines.dedup_lines(df).where("_gone > 0").collect()}
    found = collections.defaultdict(list)
    for x in near.collect():
        found[x.n].append((x.b in gone, min(len(x.ta), len(x.tb))))
    assert all(hit for v in found.values() for hit, short in v if short < lines.SEGMENTED)
    recall = {n: sum(hit for hit, _ in v) / len(v) for n, v in sorted(found.items())}
    assert len(recall) == 8 and all(x >= 0.95 for x in recall.values()), recall
    assert len(gone) == sum(hit for v in found.values() for hit, _ in v)


def test_the_query_removes_short_lines_that_repeat(spark, tmp_path):
    wide = "".join(chr(0x4E00 + i * 7) for i in range(60))
    texts = ["Read more\n\nChapter 12", f"read  more\n \nChapter 13\n{wide}", f"OK\n{wide[:30]}x{wide[31:]}\nok\nRead more"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.QUERIES["op10_fuzzy_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (texts[0], 0), 1: (f" \nChapter 13\n{wide}", 1), 2: ("OK", 3)}


def test_arrays_are_broadcast_by_their_elements(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "k int, found array<int>")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small(df, array="found"))
    monkeypatch.setattr(common, "BROADCAST_ELEMENTS", 3)
    assert not hinted(common.small(df, array="found")) and hinted(common.small(df))
