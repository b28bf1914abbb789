"""Main text of pages by a site style tree: same-host DOMs merged, entropy decides what a branch is worth.

The pages of a host are merged into one tree whose nodes are paths of tags with their classes and
ids, without digits and what names a page. A node has as presentation the sequences of child tags it has on a page, and as content the texts of its
blocks. Over the m pages of a host that have a node, its presentation is worth the entropy of its
sequences (logarithms to base m), and a text found on k of them is worth 1 - log_m(k): what every
page repeats is worth 0, what one page has is worth 1. A branch of a page is worth a mixture of
its node's presentation and the mean of its texts by length; branches worth less than a threshold
are removed with all below them. Nodes on one page only are worth 1.

Where markup states what a branch is, its worth is given: 0 for navigation, asides, footers, forms,
scripts and whatever class, id or role calls an advert, menu, notice, comment and so on; 1 for the
article or main landmark, beside which all else on the page is worth 0. The outermost landmarks count.
Inside a landmark branches need the same worth, but there a text counts as if PRIOR more pages had the node without it,
so what a few pages share stays and what every page repeats goes. Words do not settle html, body and main, nor article unless one is a whole class. Words and a form do not settle
an element that holds most of the page's text (comments apart), or a good part of it in a landmark if no landmark
is outside of such elements.

Statistics count different pages (by MD5), so copies of a page don't make its text repeated.

Defined results: a null or empty page has the empty text; a page without URL is its own host
group, the empty one; pages that repeat are rows of their own with the same text. Character
references are decoded; any white space inside a block becomes one space.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplens.llm.common import small, stored

THRESHOLD = 0.2
MIXTURE = 0.9
# Pages that a landmark adds to those of a node.
PRIOR = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their text is never shown as text; what follows up to the end tag is not markup.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav aside footer form button select option label fieldset input svg canvas object template dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An open p ends where one of these starts.
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOISE = frozenset(
    "ad ads advert adverts advertisement adsense banner banners sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidebars widget widgets footer masthead comment comments disqus respond replies cookie cookies consent gdpr notice notices popup modal"
    " overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar skip copyright"
    " contentinfo complementary search alert alerts".split()
)
HEADERS = frozenset({"header", "topbar", "site-header", "banner"})
# These may be longer than what they are about.
TALK = frozenset("comment comments disqus respond replies".split())
# Forms may wrap a page.
WRAPPING = frozenset({"form", "fieldset"})
# What may stand in a head; anything else ends it.
IN_HEAD = frozenset("title base link meta style script noscript template bgsound basefont head".split())
# Shares of a page's text from which on an element is not noise, and from which on landmarks in one are none.
MOST, PART = 0.5, 0.25

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
_RAW_END = {t: re.compile(rf"<(/)({t})([\s/][^>]*)?>", re.I) for t in RAW}
# Numbers and hexadecimal names differ from page to page.
_OWN = re.compile(r"\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b|[0-9]+", re.I)
_LAYOUT = re.compile(r"^(?:has|no|with|without|is|not)[-_]", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LINK = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = _LINK.match(url or "")
    return found[1].lower() if found else ""


class Node:
    __slots__ = ("tag", "path", "parent", "worth", "children", "length", "value", "landmark", "silent", "firm", "talk")

    def __init__(self, tag: str, path: int, parent: Node | None, worth: int | None, landmark: bool):
        self.tag, self.path, self.parent, self.worth, self.landmark = tag, path, parent, worth, landmark
        self.children: list[str] = []
        self.length = self.value = 0.0
        self.silent = worth == 0 or (parent is not None and parent.silent)
        self.firm = self.talk = False


def _attributes(tag: str, text: str) -> tuple[str, set[str], bool]:
    """The style name of a start tag, the words in it that say what it is, and whether it is a landmark."""
    if "=" not in text:
        return "", set(), False
    found = {}
    for name, a, b, c in _NAMES.findall(text):
        found.setdefault(name.lower(), a or b or c)
    # The whole page and its landmarks are one node on all pages; ids of headings are anchors.
    whole = tag in ("html", "body", "main", "article")
    style = "" if whole else ".".join(_OWN.sub("", v) for k, v in sorted(found.items()) if k != "itemprop" and (k, tag[:1], tag[1:].isdigit()) != ("id", "h", True))
    tokens = [t for k, v in found.items() if k != "itemprop" for t in v.split() if not _LAYOUT.match(t)]
    if tag in ("html", "body", "main") or found.get("role", "").lower() == "main":
        words = set()
    elif tag == "article":
        words = {t.lower() for t in tokens}
    else:
        words = {w.lower() for w in _WORD.findall(" ".join(tokens))}
    landmark = found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"
    return style, words, landmark


def parse(html: str) -> tuple[list[Node], list[tuple[str, Node]]]:
    """The elements of a page in order, and its blocks of text with the element that holds them."""
    root = Node("", 0, None, None, False)
    nodes, blocks, now, here, end = [], [], root, [], 0
    styles: dict[tuple, tuple] = {}

    def flush():
        nonlocal here
        if here:
            blocks.append(here)
            here = []

    raw = ""
    while True:
        if raw:
            m = _RAW_END[raw].search(html, end)
            raw = ""
        else:
            m = _TAG.search(html, end)
            shown = html[end : m.start() if m else len(html)]
            if now.tag == "head" and shown.strip():
                now = now.parent
            if shown and not now.firm:
                here.append((shown, now))
        if m is None:
            break
        end = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not root and node.tag != tag:
                node = node.parent
            if tag in BLOCKS:
                flush()
            if node is not root:
                now = node.parent
            continue
        if tag in BLOCKS:
            flush()
        if now.tag == "head" and tag not in IN_HEAD:
            now = now.parent
        if tag in ENDS_P:
            node = now
            while node is not root and node.tag != "p" and (node.tag not in BLOCKS):
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in CLOSES:
            node = now
            while node is not root and node.tag not in CLOSES[tag] and node.tag not in SCOPES[tag]:
                node = node.parent
            if node.tag in CLOSES[tag]:
                now = node.parent
        now.children.append(tag)
        if tag in VOID:
            continue
        key = (tag, m[3])
        if key not in styles:
            styles[key] = _attributes(tag, m[3])
        style, words, landmark = styles[key]
        landmark = landmark or tag in ("article", "main")
        worth = 0 if tag in DROPPED or words & NOISE or tag in RAW else None
        node = Node(tag, xxhash.xxh3_64_intdigest(f"{now.path}/{tag}.{style}"), now, worth, landmark)
        # Nothing that is found on the page later gives a firm element back.
        node.firm = now.firm or tag in RAW or (tag in DROPPED and tag not in WRAPPING)
        node.talk = bool(words & TALK)
        if node.worth is None and not landmark and (tag == "header" or words & HEADERS):
            node.worth = -1  # a header is noise outside of a landmark only
        nodes.append(node)
        now = node
        if tag in RAW:
            raw = tag
    flush()
    _settle(nodes, blocks)
    out = []
    for pieces in blocks:
        pieces = [(t, n) for t, n in pieces if not n.silent]
        text = " ".join(entities.unescape("".join(t for t, _ in pieces)).split())
        if text:
            out.append((text, pieces[0][1]))
    return nodes, out


def _settle(nodes: list[Node], blocks: list[list[tuple[str, Node]]]) -> None:
    """Give back elements that their words or a form would make noise but that hold the page; settle silence and landmarks."""
    sizes: dict[int, int] = {}
    total = 0
    for pieces in blocks:
        for text, node in pieces:
            n = len("".join(text.split()))
            total += n
            while node is not None:
                sizes[id(node)] = sizes.get(id(node), 0) + n
                node = node.parent
    for node in nodes:
        if node.worth is not None and not node.firm and not node.talk and sizes.get(id(node), 0) > MOST * total:
            node.worth = None
    if not any(n.landmark and _open(n) for n in nodes):
        for node in nodes:
            if node.landmark and not node.firm and sizes.get(id(node), 0) > PART * total:
                while node is not None:
                    node.worth = None
                    node = node.parent
    for node in nodes:
        node.silent = node.worth == 0 or node.parent.silent
        node.landmark = node.landmark and node.worth is None and not node.silent


def _key(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(map(str, parts))) - 2**63


def features(site: str, nodes: list[Node], blocks: list[tuple[str, Node]]) -> tuple[set, set]:
    """{(node, presentation)} and {text} keys of one page, one presentation for each node."""
    children: dict[int, set[str]] = {}
    for n in nodes:
        if n.tag not in RAW:
            children.setdefault(n.path, set()).add(" ".join(t for t, before in zip(n.children, ["", *n.children]) if t != before))
    shown = {(_key(site, path), _key(*sorted(found))) for path, found in children.items()}
    texts = {_key(site, n.path, t) for t, n in blocks}
    return shown, texts


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages, keys, values, kinds = [], [], [], []
        for site, digest, html in zip(batch["host"], batch["digest"], batch["html"], strict=True):
            shown, texts = features(site, *parse(html))
            for kind, rows in ((0, shown), (1, [(t, 0) for t in texts])):
                for k, v in rows:
                    pages.append(digest)
                    keys.append(k)
                    values.append(v)
                    kinds.append(kind)
        yield pd.DataFrame({"page": pages, "key": np.array(keys, "int64"), "value": np.array(values, "int64"), "kind": np.array(kinds, "int32")})


def main_text(site: str, html: str, presented: dict[int, tuple[float, float]], repeated: dict[int, float]) -> str:
    """The text of a page. ``presented``: (pages, worth) by node; ``repeated``: pages by text."""
    nodes, blocks = parse(html)
    marked = any(n.landmark and _open(n) for n in nodes)
    opened: dict[int, bool] = {}
    for node in nodes:  # whether a node is inside a landmark that counts
        opened[id(node)] = (node.parent.parent is not None and opened[id(node.parent)]) or (node.landmark and _open(node))
    for text, holder in blocks:
        pages = presented.get(_key(site, holder.path), (1, 1.0))[0]
        k = repeated.get(_key(site, holder.path, text), 1)
        most = max(pages, k) + (PRIOR if opened.get(id(holder)) else 0)
        worth = 1.0 if pages <= 1 or k <= 1 else max(0.0, 1 - float(np.log(k) / np.log(most)))
        node = holder
        while node is not None:
            node.length += len(text)
            node.value += len(text) * worth
            node = node.parent
    keep: dict[int, bool] = {}

    def kept(node: Node) -> bool:
        if node.parent is None:
            return not marked
        if id(node) not in keep:
            above = kept(node.parent)
            inside = marked and above
            if node.silent or (node.worth == -1 and not inside):
                keep[id(node)] = False
            elif marked and not above:
                keep[id(node)] = node.landmark and _open(node.parent) and not opened.get(id(node.parent))
            else:
                shown = presented.get(_key(site, node.path), (1, 1.0))[1]
                worth = (1 - MIXTURE) * shown + MIXTURE * (node.value / node.length if node.length else 1.0)
                keep[id(node)] = above and worth >= THRESHOLD
        return keep[id(node)]

    return "\n".join(text for text, holder in blocks if kept(holder))


def _open(node: Node) -> bool:
    """Whether no element from here up is given as noise."""
    while node is not None:
        if node.worth is not None:
            return False
        node = node.parent
    return True


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` and ``text`` of every page."""
    given, keep = keep, tuple(f"keep{i}" for i in range(len(keep)))
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(given, keep, strict=True)]
    rows = pages.select(*named, F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    site = F.lower(F.regexp_extract("_url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.select(*keep, site.alias("_host"), "_html")
    digest = F.unhex(F.md5(F.concat_ws("\n", "_host", "_html")))
    read = rows.where("_html != ''").select(F.col("_host").alias("host"), digest.alias("digest"), F.col("_html").alias("html"))
    seen = stored(read.mapInPandas(_features, "page binary, key bigint, value bigint, kind int").distinct(), "features")
    counted = seen.groupBy("kind", "key", "value").agg(F.count("*").alias("n"))
    shown = counted.where("kind = 0").groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    # A node whose pages all show the same and whose texts are all different needs no row.
    shown = shown.where("m > 1").select("key", F.col("m").cast("double"), ((F.ln("m") - F.col("s") / F.col("m")) / F.ln("m")).alias("worth"))
    repeated = counted.where("kind = 1 and n > 1").select("key", F.col("n").cast("double").alias("m"), F.lit(-1.0).alias("worth"))
    worth = stored(shown.unionByName(repeated), "worth")
    found = seen.select("page", "key").join(small(worth), "key").distinct().groupBy("page").agg(F.collect_list(F.struct("key", "m", "worth")).alias("found"))
    found = stored(found, "branches")
    joined = rows.select("*", digest.alias("page")).join(small(found, array="found"), "page", "left").drop("page")
    kinds = dict(joined.dtypes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for site_, source, known in zip(batch["_host"], batch["_html"], batch["found"], strict=True):
                known = [] if known is None else known
                presented = {x["key"]: (x["m"], x["worth"]) for x in known if x["worth"] >= 0}
                texts.append(main_text(site_, source, presented, {x["key"]: x["m"] for x in known if x["worth"] < 0}) if source else "")
            yield batch[list(keep)].assign(text=texts)

    out = joined.mapInPandas(cut, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string")
    return out.select(*[F.col(k).alias(c) for c, k in zip(given, keep, strict=True)], "text")
