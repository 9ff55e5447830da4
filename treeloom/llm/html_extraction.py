"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element and run of text is a row with features of its tag, the tokens of its class,
id and role, its ancestors' tokens, depth, siblings, and the density of text, links and
punctuation in its subtree. Trees give each node the log-odds of holding main text, and a
hierarchical decoding picks the best set of nodes in which every kept node's parent is
kept: no text can survive inside a dropped ancestor, and an ancestor is kept only for what
its descendants are worth.

No page is labelled by hand. A bounded sample of pages is labelled by its own semantic
tags (``article`` or ``main`` outside ``nav``, ``footer``, ``aside`` and the like), and is
trained on together with copies whose semantic tags are renamed to common class names or
stripped, and to which comments, notices, sidebars and forms made of other pages' text are
added; so the trees learn from tokens, densities and places as well as from tag names.
"""

from __future__ import annotations

import html as entities
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, grow
from .dom import BLOCK, RAW, TEXT, Page, parse, tokens

SAMPLE_PAGES = 200  # pages that are learned from, those with the smallest id hashes
SAMPLE_CHARS = 50_000  # of a page, without scripts and styles, that are learned from
COPIES = 4  # changed copies of each

#: Words in class, id and role names, by what they are a sign of.
SIGNS = {
    "content": "article content post story entry main body text page blog prose markdown",
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "edge": "header masthead banner footer foot copyright contentinfo colophon legal logo topbar",
    "advert": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion dfp outbrain taboola",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader responses thread",
    "side": "sidebar side aside widget complementary rail related recommended recommendations more popular trending share sharing social follow tags author bio",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall warning message disclaimer",
    "form": "form login search input field fieldset contact",
}
GROUP = {word: i for i, words in enumerate(SIGNS.values()) for word in words.split()}
#: Groups of tags, by number; a tag in none of them has 0.
TAGS = {t: i for i, ts in enumerate(("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "a", "div", "section", "article main", "nav menu", "header", "footer", "aside", "form input button select option textarea label fieldset", "table thead tbody tfoot tr td th caption", "script style noscript template iframe svg head title meta link object embed", "ul ol dl", "blockquote pre code figure figcaption", TEXT, "html body #page"), 1) for t in ts.split()}
KINDS = max(TAGS.values()) + 1
NEGATIVE_TAGS = frozenset("nav menu header footer aside form button select textarea script style noscript template iframe svg head title object dialog".split())
UNSEEN = RAW | frozenset("head noscript template svg object".split())  # never text of a page


class Nodes:
    """The rows of several pages end to end, and their features."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        first = np.cumsum(sizes) - sizes
        self.first, self.sizes, n = first, sizes, int(sizes.sum())
        base = np.repeat(first, sizes)
        own = np.array([x for p in pages for x in p.parent], np.int64)
        self.parent = np.where(own < 0, np.arange(n), own + base)
        self.depth = np.array([x for p in pages for x in p.depth], np.int64)
        self.root = own < 0
        tag = [t for p in pages for t in p.tag]
        self.kind = np.fromiter((TAGS.get(t, 0) for t in tag), np.int64, n)
        self.is_text = np.fromiter((t is TEXT for t in tag), bool, n)
        order = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[order], np.arange(1, (self.depth.max() if n else 0) + 2))
        self.levels = np.split(order, cut)[:-1] if n else []  # rows of each depth
        self.signs = np.zeros((n, len(SIGNS)), np.float32)
        for i, a in enumerate(x for p in pages for x in p.attributes):
            for t in tokens(a) if a else ():
                if (g := GROUP.get(t)) is not None:
                    self.signs[i, g] = 1
        texts = [x for p in pages for x in p.text]
        self.chars = np.fromiter(map(len, texts), np.float64, n)
        self.words = np.fromiter((x.count(" ") + 1 if x else 0 for x in texts), np.float64, n)
        self.marks = np.fromiter((x.count(".") + x.count(",") + x.count(";") + x.count("?") + x.count("!") if x else 0 for x in texts), np.float64, n)
        hidden = np.fromiter((t in UNSEEN for t in tag), bool, n)
        for rows in self.levels[1:]:
            hidden[rows] |= hidden[self.parent[rows]]
        self.hidden = hidden
        inline = np.fromiter((t is not TEXT and t not in BLOCK and t != "#page" for t in tag), bool, n) & ~self.signs.any(axis=1)
        self.home = self.parent.copy()  # the nearest ancestor that is more than a part of a line
        for rows in self.levels[1:]:
            up = self.parent[rows]
            self.home[rows] = np.where(inline[up], self.home[up], up)
        for x in (self.chars, self.words, self.marks):
            x[hidden] = 0

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum over each row's subtree."""
        out = values.astype(np.float64).copy()
        for rows in self.levels[:0:-1]:
            np.add.at(out, self.parent[rows], out[rows])
        return out

    def inherited(self, values: np.ndarray) -> np.ndarray:
        """Largest value among each row's ancestors."""
        out = np.zeros_like(values)
        for rows in self.levels[1:]:
            up = self.parent[rows]
            out[rows] = np.maximum(out[up], values[up])
        return out

    def features(self) -> np.ndarray:
        n = len(self.parent)
        chars, words, marks = self.summed(self.chars), self.summed(self.words), self.summed(self.marks)
        link = np.where(self.inherited((self.kind == TAGS["a"]).astype(np.float64)) > 0, self.chars, 0)
        link = self.summed(link)
        count, leaves = self.summed(np.ones(n)), self.summed(self.is_text & ~self.hidden)
        paragraphs, items = self.summed(self.kind == TAGS["p"]), self.summed(self.kind == TAGS["li"])
        fields = self.summed(self.kind == TAGS["form"])
        up = self.parent
        kids = np.bincount(up, ~self.root, n)
        sibling_chars = np.bincount(up, np.where(self.root, 0, chars), n)[up] - np.where(self.root, 0, chars)
        siblings = np.maximum(kids[up] - 1, 0)
        alike = np.unique(up * KINDS + self.kind, return_inverse=True)[1]
        same = np.bincount(alike)[alike] - 1
        page = np.repeat(np.arange(len(self.sizes)), self.sizes)
        total = np.maximum(chars[self.first], 1)[page] if n else chars
        before = np.cumsum(self.chars) - self.chars
        before = before - before[self.first][page] if n else before
        order = (np.arange(n) - self.first[page]) / np.maximum(self.sizes[page], 1) if n else np.zeros(0)
        hot = np.eye(KINDS, dtype=np.float64)[self.kind]
        outside = np.maximum(self.signs[:, 1:].max(axis=1, initial=0), np.isin(self.kind, [TAGS[t] for t in ("nav", "header", "footer", "aside", "form", "script")]))
        inside = np.maximum(self.signs[:, 0], self.kind == TAGS["article"])
        return np.column_stack(
            [
                np.maximum(outside, self.inherited(outside)), np.maximum(inside, self.inherited(inside)), hot, self.inherited(hot), self.signs, self.inherited(self.signs), self.signs[up],
                self.depth, np.log1p(chars), np.log1p(self.chars), chars / total, link / np.maximum(chars, 1), marks / np.maximum(words, 1), words / np.maximum(leaves, 1),
                np.log1p(count), chars / count, np.log1p(paragraphs), np.log1p(items), np.log1p(fields), np.log1p(kids), siblings, same, sibling_chars / np.maximum(siblings, 1), chars / np.maximum(chars + sibling_chars, 1),
                before / total, (before + chars) / total, order, np.log1p(chars[up]), (link / np.maximum(chars, 1))[up], np.log1p(paragraphs[up]),
            ]
        )

    def smoothed(self, log_odds: np.ndarray) -> np.ndarray:
        """Log-odds drawn towards those of like siblings (for text: of texts in like siblings of its block) and of the parent."""
        up = self.parent
        place = np.where(self.is_text, up[self.home], up)
        like = np.where(self.is_text, self.home, np.arange(len(up)))
        signs = (self.signs[like] @ (1 << np.arange(len(SIGNS)))).astype(np.int64)
        group = np.unique(((place * 2 + self.is_text) * KINDS + self.kind[like]) << len(SIGNS) | signs, return_inverse=True)[1]
        seen = ~self.hidden
        mean = np.bincount(group, log_odds * seen) / np.maximum(np.bincount(group, seen), 1)
        out = 0.35 * log_odds + 0.45 * mean[group]
        for rows in self.levels[1:]:
            out[rows] += 0.2 * out[up[rows]]
        return out

    def decoded(self, log_odds: np.ndarray) -> np.ndarray:
        """Rows to keep: the set with the largest sum of log-odds in which every row's parent is kept too."""
        worth = np.where(self.hidden, -1e9, self.smoothed(log_odds))
        gain = worth.copy()
        for rows in self.levels[:0:-1]:
            np.add.at(gain, self.parent[rows], np.maximum(gain[rows], 0))
        keep = gain > 0
        for rows in self.levels[1:]:
            keep[rows] &= keep[self.parent[rows]]
        return keep


def text_of(page: Page, keep: np.ndarray) -> str:
    """Kept texts, character references decoded in each run of text alone, one line for each block."""
    blocks: dict[int, list[str]] = {}
    for i in np.flatnonzero(keep).tolist():
        if page.tag[i] is TEXT:
            blocks.setdefault(page.block[i], []).append(" " * (i in page.breaks) + entities.unescape(page.text[i]))
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def weak_labels(page: Page) -> list[bool]:
    """Which rows hold main text, by the page's own semantic tags; by long, linkless paragraphs if it has neither article nor main."""
    n = len(page.tag)
    inside, outside, label = [False] * n, [False] * n, [False] * n
    semantic = any(t in ("article", "main") for t in page.tag)
    for i in range(n):
        up = page.parent[i]
        t = page.tag[i]
        group = {GROUP[w] for w in tokens(page.attributes[i]) if w in GROUP}
        inside[i] = (up >= 0 and inside[up]) or t in ("article", "main") or (not semantic and t in ("p", "h1", "blockquote", "pre"))
        outside[i] = (up >= 0 and outside[up]) or t in NEGATIVE_TAGS or (bool(group - {0}) and 0 not in group)
        if t is TEXT and inside[i] and not outside[i] and not page.text[i].isspace() and (semantic or page.text[i].count(" ") >= 8):
            k = i
            while k >= 0 and not label[k]:
                label[k] = True
                k = page.parent[k]
    return label


#: Tag and class names that stand for a region in real pages; fixed values, as plain pairs. No tag: the region's rows stand in its parent.
NAMES = {
    "article": [("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content"), ("section", "story-body"), ("div", "article-body"), ("div", "main"), ("div", ""), ("section", ""), ("", "")],
    "nav": [("nav", ""), ("div", "menu"), ("div", "navbar"), ("ul", "navigation"), ("div", "breadcrumbs"), ("div", "")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright"), ("div", "legal")],
    "ad": [("div", "ad"), ("aside", "promo"), ("div", "advert"), ("div", "sponsored"), ("ins", "adsbygoogle"), ("div", "banner-ad")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-header"), ("div", "topbar")],
    "comment": [("div", "comments"), ("section", "comments"), ("ol", "commentlist"), ("div", "comment"), ("div", "disqus_thread"), ("section", "reader-comments"), ("ul", "replies"), ("div", "respond")],
    "side": [("aside", ""), ("div", "sidebar"), ("aside", "widget"), ("div", "related"), ("section", "recommended"), ("div", "share"), ("ul", "social")],
    "notice": [("div", "notice"), ("div", "cookie-banner"), ("div", "alert"), ("div", "newsletter"), ("p", "notice"), ("div", "cookie-consent"), ("section", "subscribe"), ("div", "disclaimer")],
    "form": [("form", ""), ("form", "search"), ("div", "login"), ("form", "contact-form")],
}


def changed(page: Page, label: list[bool], others: list[str], rng: random.Random) -> tuple[Page, list[bool]]:
    """A copy with other names for its regions and with regions added; text that is added is no main text."""
    out, kept = Page(), []
    name = {k: rng.choice(v) for k, v in NAMES.items()}
    plain = rng.random() < 0.3

    def put(parent: int, tag: str, attributes: str = "", text: str = "", is_main: bool = False) -> int:
        kept.append(is_main)
        return out.add(parent, tag, attributes, text)

    def region(parent: int, kind: str) -> None:
        tag, names = rng.choice(NAMES[kind])
        top = put(parent, tag, names)
        if kind == "form":
            for _ in range(rng.randint(1, 4)):
                put(put(top, "label"), TEXT, text=" ".join(rng.choice(others).split()[: rng.randint(1, 4)]))
                put(top, rng.choice(["input", "button", "textarea"]))
        if kind in ("side", "header", "nav") and rng.random() < 0.7:
            ul = put(top, "ul")
            for _ in range(rng.randint(2, 8)):
                put(put(put(ul, "li"), "a"), TEXT, text=" ".join(rng.choice(others).split()[: rng.randint(1, 6)]))
        for _ in range(rng.randint(1, 5 if kind in ("comment", "side") else 2)):
            inner = put(top, rng.choice(["div", "li", "p", "p"]), rng.choice(["", "", names]))
            where = put(inner, "p") if out.tag[inner] != "p" and rng.random() < 0.5 else inner
            words = rng.choice(others).split()
            put(where, TEXT, text=" ".join(words[: rng.randint(3, 60)]))

    place: dict[int, int] = {-1: -1}
    added = [k for k in ("comment", "side", "notice", "form", "header", "comment", "notice") if rng.random() < 0.45]
    insides = [k for k in added if rng.random() < 0.4]
    ends: dict[int, list[str]] = {}
    first_article = next((i for i, t in enumerate(page.tag) if t in ("article", "main")), None)
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    last_inside = max([i for i in range(len(page.tag)) if first_article is not None and descends(page, i, first_article)], default=None)
    if last_inside is not None:
        ends[last_inside] = [("in", k) for k in insides] + [("out", k) for k in added if k not in insides and k != "header"]
    for i, t in enumerate(page.tag):
        tag, attributes = t, page.attributes[i]
        if t in ("article", "main"):
            tag, attributes = name["article"]
        elif t in ("nav", "footer", "header"):
            tag, attributes = name[t]
        elif "ad" in tokens(attributes):
            tag, attributes = name["ad"]
        if plain and t not in ("article", "main"):
            attributes = attributes if rng.random() < 0.5 else ""
        place[i] = put(place[page.parent[i]], tag, attributes, page.text[i], label[i]) if tag else place[page.parent[i]]
        if i == body:
            for k in added:
                if k in ("header", "notice") and k not in insides:
                    region(place[i], k)
        for where, k in ends.get(i, ()):
            region(place[first_article] if where == "in" else place[page.parent[first_article]], k)
    return out, kept


def descends(page: Page, i: int, top: int) -> bool:
    while i > top:
        i = page.parent[i]
    return i == top


def in_page_order(page: Page, label: list[bool]) -> tuple[Page, list[bool]]:
    """Rows in the order of a walk, so that regions added later stand where they belong."""
    children: dict[int, list[int]] = {}
    for i, up in enumerate(page.parent):
        children.setdefault(up, []).append(i)
    out, kept, place = Page(), [], {-1: -1}
    stack = children.get(-1, [])[::-1]
    while stack:
        i = stack.pop()
        place[i] = out.add(place[page.parent[i]], page.tag[i], page.attributes[i], page.text[i], page.block[i])
        kept.append(label[i])
        stack += children.get(i, [])[::-1]
    return out, kept


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Learns from SAMPLE_PAGES pages, the first SAMPLE_CHARS characters of each without scripts and styles, and COPIES changed copies of each.

    Where no main text can be seen in any of them, which is so for an empty table, ``own_pages`` are learned from instead.
    """
    usable = pages.filter(F.length(html_col) > 0).select(F.xxhash64(id_col).alias("h"), F.col(html_col).alias("html"))
    chosen = [r["h"] for r in usable.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]  # hashes alone are ranked: tasks send no pages for it
    cut = F.substring(F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", ""), 1, SAMPLE_CHARS)
    rows = usable.filter(F.col("h").isin(chosen)).select("h", cut.alias("html")).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return learned([r["html"] for r in rows])


def own_pages(n: int = SAMPLE_PAGES, seed: int = 3) -> list[str]:
    """Pages of made-up words in the plainest layout, for tables from which nothing can be learnt."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10)))
    line = lambda least, most: " ".join(word() for _ in range(rng.randrange(least, most))).capitalize() + "."
    menu = lambda: "".join(f'<li><a href="/{i}">{word()}</a></li>' for i in range(rng.randrange(3, 9)))
    body = lambda: "".join(f"<p>{line(1, 50)}</p>" for _ in range(rng.randrange(1, 9)))
    return [f'<html><head><title>{word()}</title></head><body><header><h2>{word()}</h2></header><nav><ul>{menu()}</ul></nav><div class="ad">{line(3, 9)}</div><article><h1>{line(2, 7)}</h1>{body()}</article><footer>{line(2, 8)}</footer></body></html>' for _ in range(n)]


def learned(htmls: list[str]) -> Trees:
    """Trees of these pages, or of own_pages where they show no main text."""
    rng = random.Random(7)
    whole = [parse(h) for h in htmls]
    labels = [weak_labels(p) for p in whole]
    if not any(map(any, labels)):
        whole = [parse(h) for h in own_pages()]
        labels = [weak_labels(p) for p in whole]
    others = [t for p in whole for t in p.text if t.count(" ") > 3] or ["some text of another page"]
    table = list(zip(whole, labels))
    for p, l in zip(whole, labels):
        table += [in_page_order(*changed(p, l, others, rng)) for _ in range(COPIES)]
    x, y = [], []
    for k in range(0, len(table), 100):
        nodes = Nodes([p for p, _ in table[k : k + 100]])
        seen = ~nodes.hidden
        x.append(nodes.features()[seen].astype(np.float32))
        y.append(np.array([v for _, l in table[k : k + 100] for v in l], np.float64)[seen])
    return grow(np.concatenate(x), np.concatenate(y))


def extracted(trees: Trees, htmls: list) -> list[str]:
    pages = [parse(h) for h in htmls]
    nodes = Nodes(pages)
    keep = nodes.decoded(trees.log_odds(nodes.features()))
    return [text_of(p, keep[s : s + n]) for p, s, n in zip(pages, nodes.first.tolist(), nodes.sizes.tolist())]


def extract(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """pages with ``text``; empty for null, empty and textless pages. A column of that name is replaced."""
    pages = pages.drop("text")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])
    at = pages.columns.index(html_col)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            start, sizes = 0, [len(x or "") for x in batch.column(at).to_pylist()]
            while start < batch.num_rows:  # about half a million characters of markup at a time
                end, total = start + 1, sizes[start]
                while end < batch.num_rows and total + sizes[end] <= 500_000:
                    total += sizes[end]
                    end += 1
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(extracted(shared.value, part.column(at).to_pylist()), pa.string())], names=[*part.schema.names, "text"])
                start = end

    return pages.mapInArrow(run, schema)
