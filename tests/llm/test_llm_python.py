"""Extraction, toxicity, tokens, encoding and vectors on hand-made rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from triplens.llm import bpe, html, tokens, toxicity, vectors

PAGES = [
    ('<div class="menu"><a>x</a></div><p>A &amp; B<br>c &lt;d&gt; &#233;</p>', "A & B\nc <d> é"),
    ('<main><header><h1>T</h1></header><p>x  y\n z<div class="comments"><article>no</article></div></main><aside>q</aside>', "T\nx y z"),
    ("plain text < 5 & more", "plain text < 5 & more"),
    ("<article><p>one<script>if(a<b){}</script> two<ul><li>a<li>b</ul></article><p>out", "one two\na\nb"),
    ("<p>unclosed <b", "unclosed"),
    ('<article>a</article><article class="comment">b</article>', "a"),
    ("<!-- <article>x</article> --><body><h1>T</h1><table><tr><td>1<td>2</table>", "T\n1\n2"),
    ('<article><h1>H</h1><p>in <span class="ad">buy</span>line</p><form>f</form><p>last</article><footer>&copy;</footer>', "H\nin line\nlast"),
    ("<ARTICLE><P>Upper<TEXTAREA>no</TEXTAREA></ARTICLE>", "Upper"),
    ("<title>t</title><style>p{}</style>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_markup_that_states_its_branches(page, text):
    assert html.main_text("host", page, {}, {}) == text


TEXT = "The story has many words of its own and they are most of the page."
WHOLE = [
    f"<html><body class='has-sidebar'><p>{TEXT}</p></body></html>",
    f"<body class='no-sidebar search'><article>{TEXT}</article></body>",
    f"<body><main class='content with-sidebar'>{TEXT}</main></body>",
    f"<article class='post share-enabled'>{TEXT}</article>",
    f"<div class='search-layout social'><div><p>{TEXT}</p></div></div><div class='related'>more</div>",
    f"<div id='alert-wrap'><article>{TEXT}</article></div><div><p>{'other words ' * 8}</p></div>",
    f"<body><form action='x.aspx'><div class='menu'>Home</div><p>{TEXT}</p><select><option>x</select></form></body>",
    f"<html><head><title>t</title><meta charset=x><body><p>{TEXT}</p></body></html>",
    f"<head><title>t</title>{TEXT}",
    f"<div>{TEXT}</div><aside><article>Not this one</article></aside>",
]


@pytest.mark.parametrize("page", WHOLE)
def test_words_and_forms_do_not_empty_a_page(page):
    assert html.main_text("host", page, {}, {}) == TEXT


def test_noise_inside_a_page_goes():
    page = f"<main><p>{TEXT}</p><div class='comment-list'><article>{TEXT * 3}</article></div><div class='main-menu'>x</div></main>"
    assert html.main_text("host", page, {}, {}) == TEXT


def test_entropy_removes_what_pages_of_a_host_repeat(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><span>Home Products About</span></div><div><p>Story {i} of its own words {i * 7}</p></div><div>All rights</div></body>") for i in range(30)]
    pages += [(100, "http://single.example/", "<body><div>Home Products About</div><div><p>Only page</p></div></body>")]
    pages += [(101, None, None), (102, "http://h.example/x", ""), (103, None, "<p>no url</p>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(i, u, h, "t", "k") for i, u, h in pages], "page_id long, url string, html string, text string, page string")
    got = [(r.page_id, r.text) for r in html.extract(df).collect()]
    want = [(i, f"Story {i} of its own words {i * 7}") for i in range(30)]
    want += [(100, "Home Products About\nOnly page"), (101, ""), (102, ""), (103, "no url"), want[0]]
    assert sorted(got) == sorted(want)


def test_entropy_decides_inside_landmarks_too(spark):
    inner = "<div class='zq{i} x'><p>Read this on our site every day</p></div>"
    pages = [(i, f"http://h.example/{i}", f"<body class='p{i}'><article id='post-{i}'><h1 id='a{'b' * i}'>Title {i * 3}</h1><div id='c-{i}'><p>Story {i} of its own</p></div>{inner.format(i=i)}</article></body>") for i in range(30)]
    pages += [(100 + i, f"http://two.example/{i}", f"<main><p>Shared by two</p><p>Own {i}</p></main>") for i in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: f"Title {i * 3}\nStory {i} of its own" for i in range(30)} | {100 + i: f"Shared by two\nOwn {i}" for i in range(2)}


def test_copies_of_a_page_do_not_make_its_text_repeated(spark):
    pages = [(i, "http://h.example/a", "<body><div><p>The same page in many copies</p></div></body>") for i in range(50)]
    pages += [(90, "http://h.example/b", "<body><div><p>Another one</p></div></body>")]
    out = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {"The same page in many copies", "Another one"}


def brute_segments(weights):
    """Maximal segments by their definition: the best segment, then the best of what lies left and right."""
    if not len(weights):
        return []
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    best = max(((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute_segments(weights[:i]) + [(best[0], i, j - 1)] + [(s, a + j, b + j) for s, a, b in brute_segments(weights[j:])]


def test_segments_equal_brute_force():
    r = random.Random(2)
    for _ in range(200):
        w = [r.choice([3.0 + r.random(), 0.35 + r.random() / 7]) if r.random() < 0.2 else -toxicity.DRIFT for _ in range(r.randrange(1, 40))]
        got = toxicity.segments([(i, x) for i, x in enumerate(w) if x > 0])
        want = brute_segments(np.array(w))
        assert [x[1:] for x in got] == [x[1:] for x in want]
        assert np.allclose([x[0] for x in got], [x[0] for x in want])


def toxic_frames(spark, n=400):
    r = random.Random(1)
    clean = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = [r.choice(clean) for _ in range(r.randrange(20, 200))]
        toxic = int(i % 4 == 0)
        if toxic:
            at = r.randrange(len(ws))
            ws[at:at] = [r.choice(["vilewordone", "nastyword", "horridword"]) for _ in range(4)]
        docs.append((i, " ".join(ws), "en", 0.5))
        labels.append((i, 1, toxic))
    docs += [(9000, None, "en", 0.1), (9001, "", "en", 0.1), (None, "plain1 plain2", "en", 0.1), (9002, "plain1 " * 50_000, "en", 0.1)]
    labels += [(9000, 1, None), (0, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart(spark):
    docs, labels = toxic_frames(spark)
    out = {r.doc_id: r for r in toxicity.score(docs.drop("toxic"), labels).collect()}
    assert len(out) == 404
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[9000].score < 0.3 and out[9002].score < 0.3
    text = docs.where("doc_id = 4").first().text
    found = [text[p.start : p.end] for p in out[4].passages]
    assert any("word" in f for f in found)


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = toxic_frames(spark, 200)
    docs = docs.drop("toxic")
    other = labels.selectExpr("doc_id", "quality", f"CASE WHEN {toxicity.TRAINED_ON} THEN toxic ELSE 1 - toxic END AS toxic")
    a = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs, other).collect()}
    assert a == pytest.approx(b)


def test_toxicity_of_empty_tables(spark):
    docs, labels = toxic_frames(spark, 10)
    docs = docs.drop("toxic")
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, labels.limit(0)).collect())


def test_joined_pieces_equal_the_whole():
    path = bpe.vocabulary()
    r = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzéüÉ'!?#1234"
    for kind in range(120):
        if kind % 3 == 0:
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(50, 1500)))
        elif kind % 3 == 1:
            text = r.choice(["a", "ab", "the", "ha", "!", "é", "1", "aaab", " ", "<|endoftext|>"]) * r.randrange(20, 500)
        else:
            text = " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(1, 9))) for _ in range(200))
        cuts = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randrange(1, 6))))
        pieces = [bpe.spans(path, text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        got = [i for i, _, _ in bpe.concatenate(path, text, pieces, cuts)]
        assert got == bpe.load(path).encode(text, add_special_tokens=False).ids, (kind, text[:50])


def test_encoding_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 300)
    path = bpe.vocabulary()
    texts = [None, "", " \n ", "é X<|endoftext|> y", "\x1c\x1d a\x1eb", "foo\x85bar​baz", "ΣΑΣ ﬁ① 한국어 👩‍👩‍👧", "x" * 2000, "Word " * 500, "Word " * 500, "l'été's don't " * 90]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, ids int, node string")
    made = bpe.load(path)
    got = {r.doc_id: r for r in bpe.encode(df, path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = made.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert hashlib.sha256(got[i].decoded.encode()).digest() == hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).digest()
    assert bpe.encode(df.limit(0), path).count() == 0


def brute_tokens(text, starts, rule):
    first, last = tokens.spans(text, *tokens.vocabulary())
    ends, out = [*starts[1:], len(text)], [0.0] * len(starts)
    for s, e in zip(first, last, strict=True):
        held = [max(0, min(e, b) - max(s, a)) for a, b in zip(starts, ends, strict=True)]
        if rule == "share":
            out = [o + h / sum(held) for o, h in zip(out, held, strict=True)]
        else:
            out[held.index(max(held)) if rule == "most" else next(i for i, h in enumerate(held) if h)] += 1
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens_equal_brute_force(spark, rule):
    from pyspark.sql import functions as F

    texts = [None, "", "\n", "one\n\n\n  two three\nfour", "日本語 テキスト\n👩‍👩‍👧 é\n", "a\n" * 300, "long " * 4000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    got = {(r.doc_id, r.section): r for r in tokens.section_tokens(df, *tokens.vocabulary(), rule=rule).collect()}
    for i, t in enumerate(texts):
        starts = tokens.line_starts(t or "").tolist()
        for k, n in enumerate(brute_tokens(t or "", starts, rule)):
            assert got.pop((i, k)).n_tokens == pytest.approx(n)
    assert not got
    cut = tokens.section_tokens(df.where("doc_id = 3"), *tokens.vocabulary(), rule=rule, starts=F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(9))).collect()
    assert [r.n_tokens for r in cut] == pytest.approx(brute_tokens(texts[3], [0, 2, 2, 9], rule))
    assert tokens.section_tokens(df.limit(0), *tokens.vocabulary(), rule=rule).count() == 0


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((6, 16))
    rows = []
    for i in range(240):
        v = base[i % 6] + r.standard_normal(16) * r.choice([0.05, 0.2, 0.6])
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(300 + i, base[0].tolist(), 0) for i in range(30)] + [(400, base[0].tolist(), None), (401, None, 0), (402, [0.0] * 16, 0)]
    rows += [(403, [float("nan")] + [1.0] * 15, 0), (404, [None] + [1.0] * 15, 0), (405, [], 0), (406, base[0].tolist()[:8], 0), (407, (base[0] * 50).tolist(), 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame([(i, v, la, "x", 1) for i, v, la in rows], "vec_id long, embedding array<double>, label int, node string, copies int")
    out = vectors.near_vectors(df).collect()
    assert len(out) == len(rows)
    usable = [(i, np.array(v), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    n = len(usable)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and usable[a][2] == usable[b][2] and len(usable[a][1]) == len(usable[b][1]):
                link[a, b] = usable[a][1] @ usable[b][1] / np.linalg.norm(usable[a][1]) / np.linalg.norm(usable[b][1]) >= vectors.SIMILARITY
    want = {}
    for k, (i, _, _) in enumerate(usable):
        want.setdefault(i, int(link[k].sum()))
    got = {x.vec_id: x for x in out}
    total = sum(want.values())
    assert all(got[i].n_links <= w for i, w in want.items())
    assert sum(got[i].n_links for i in want) >= 0.97 * total
    for i in (400, 401, 402, 403, 404, 405, 406):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(3)
    base = r.standard_normal(16)
    rows = [(i, (base + r.standard_normal(16) * 0.02).tolist(), 1) for i in range(200)]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all((x.n_links, x.component_id) == (199, 0) for x in out)


def test_planes_follow_the_label_and_recall_stays(spark):
    from pyspark.sql import functions as F

    sizes = [1, 1000, 1 << 14, 1 << 18, 1 << 40]
    out = spark.createDataFrame([(n,) for n in sizes], "n long").select(vectors.planes_for(F.col("n")).alias("p")).collect()
    assert [x.p for x in out] == [12, 12, 16, 20, 30]
    agree = 1 - np.arccos(vectors.SIMILARITY) / np.pi
    assert all(1 - (1 - agree**p) ** vectors.tables(p) >= vectors.RECALL for p in range(12, 31))


def test_labels_of_different_planes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "EVEN", 0.001)
    r = np.random.default_rng(11)
    rows = []
    for i in range(900):
        label = 0 if i % 9 else 1
        v = r.standard_normal(16) if i % 3 else np.ones(16) * (1 if i % 2 else -1) + r.standard_normal(16) * 0.35
        rows.append((i, v.tolist(), label))
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    labels = np.array([la for _, _, la in rows])
    link = (unit @ unit.T >= vectors.SIMILARITY) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    got = np.zeros(len(rows), int)
    for x in out:
        got[x.vec_id] = x.n_links
    want = link.sum(axis=1)
    assert (got <= want).all() and want.sum() > 500
    assert got.sum() >= 0.99 * want.sum()
