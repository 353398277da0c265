"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into a tree of elements and text runs. Every node gets features: kind of tag, words in its class and id
attributes (own and inherited), depth, place among its siblings, and density of text, links and punctuation in its subtree.
Boosted trees give each node the probability that its subtree holds main text. The decoding picks the most probable
labelling in which no node holds main text below one that holds none: one pass up the tree for the best values, one down.

The trees are trained in numpy, on the driver, from pages assembled around text of a bounded sample of the table's own
pages, so that every node's label is known: menus, headers, footers, sidebars, notices, adverts, forms and comments, in
semantic elements, in named containers or in bare ones, around and inside an article. Scripts, styles, templates and comments
of the markup are never text. A formula (MathML) is part of the text it stands in, and
the trees decide on the text of drawings (SVG); annotations, metadata, titles and descriptions of both, which no browser shows in
the page, are not text.

Blocks are what block elements part; inside a block, white space counts as one space. The whole page is parsed, in time linear
in its length.

Defined results: null and empty pages give the empty text; a page without main text likewise; broken markup is repaired as
the parser can, an end tag without a start is ignored; repeated rows give the same text; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- parsing -------------------------------------------------------------------------------------------------------

#: Element names by role (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title object iframe canvas audio video select textarea annotation annotation-xml metadata desc".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "p": BLOCKS - {"td", "th", "body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
    "head": frozenset({"body"}),
}
#: Elements that keep a start tag from closing what lies outside of them.
WALLS = {
    "li": frozenset({"ul", "ol", "menu"}),
    "dt": frozenset({"dl"}),
    "dd": frozenset({"dl"}),
    "tr": frozenset({"table"}),
    "td": frozenset({"table"}),
    "th": frozenset({"table"}),
    "p": frozenset({"td", "th", "table", "button"}),
    "option": frozenset({"select"}),
    "head": frozenset(),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>])*?)>",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TEXT = "#text"


@dataclass
class Page:
    """Nodes in document order: tag, parent, attribute words, own text (of text runs)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def add(self, tag: str, parent: int, names: str = "", text: str = "") -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.texts.append(text)
        return len(self.tags) - 1


def parse(html: str) -> Page:
    page = Page()
    page.add("html", -1)
    stack, names = [0], ["html"]
    hidden = 0  # open elements whose text is not shown
    formula = 0  # open formulas: their elements are no nodes, their text goes on in the run it stands in
    glue = False  # the last run may go on
    at, end = 0, len(html)

    def pop_to(size: int) -> None:
        nonlocal hidden, formula
        while len(stack) > size:
            stack.pop()
            name = names.pop()
            hidden -= name in UNSEEN
            formula -= name == "math"

    def say(text: str) -> None:
        nonlocal glue
        if (formula or glue) and page.tags[-1] == TEXT and page.parents[-1] == stack[-1]:
            page.texts[-1] += text
        elif not text.isspace():
            page.add(TEXT, stack[-1], "", text)
        else:
            page.add(" ", stack[-1], "", " ")
        glue = formula > 0 or glue and text.isspace()

    while at < end:
        hit = TOKEN.search(html, at)
        upto = hit.start() if hit else end
        if upto > at and not hidden:
            text = unescape(html[at:upto]) or " "
            if text := text.strip() if formula else text:
                say(text)
        if hit is None:
            break
        at = hit.end()
        tag = hit[2]
        if tag is None:
            if hit[0].startswith("<![CDATA[") and not hidden:
                page.add(TEXT, stack[-1], "", hit[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if hit[1]:
            if tag in names[1:]:
                pop_to(len(names) - 1 - names[::-1].index(tag))
            continue
        for inner, closers in CLOSED_BY.items():
            if tag in closers and inner in names:
                place = len(names) - 1 - names[::-1].index(inner)
                if not WALLS[inner].intersection(names[place + 1 :]):
                    pop_to(place)
        if tag == "html":
            continue
        attributes = hit[3]
        words = " ".join((a or b or c).lower() for _, a, b, c in NAMES.findall(attributes)) if "=" in attributes else ""
        if formula and tag in BLOCKS:
            pop_to(names.index("math"))
        node = stack[-1] if formula or tag == "math" else page.add(tag, stack[-1], words)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        stack.append(node)
        names.append(tag)
        hidden += tag in UNSEEN
        formula += tag == "math"
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = close.start() if close else end
    return page


# ---- features ------------------------------------------------------------------------------------------------------

#: Groups of tags, and of words in class, id and role, that are features of their own.
TAG_GROUPS = (
    ("article", "main"),
    ("section",),
    ("div",),
    ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"),
    ("nav",),
    ("header",),
    ("footer",),
    ("aside",),
    ("form", "fieldset", "label", "button", "legend"),
    ("a",),
    (TEXT,),
    ("body", "html"),
    ("table", "tbody", "tr", "td", "th", "thead"),
)
WORD_GROUPS = (
    ("article", "content", "main", "post", "entry", "story", "body", "text"),
    ("nav", "menu", "breadcrumb", "breadcrumbs", "navbar", "navigation", "links", "tabs", "pagination", "pager"),
    ("header", "masthead", "banner", "logo", "top", "brand", "head"),
    ("footer", "copyright", "bottom", "foot", "legal", "contentinfo"),
    ("sidebar", "aside", "widget", "related", "rail", "complementary", "recommended", "popular", "more"),
    ("notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "gdpr", "overlay", "message", "dialog"),
    ("ad", "ads", "advert", "adverts", "advertisement", "promo", "promotion", "sponsor", "sponsored", "adbox", "teaser"),
    ("form", "subscribe", "newsletter", "search", "signup", "login", "contact"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus", "reader", "respond", "feedback"),
    ("share", "social", "follow", "byline", "meta", "tags", "author"),
)
TAG_OF = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}
WORD_OF = {w: 1 << i for i, group in enumerate(WORD_GROUPS) for w in group}
SPLIT = re.compile(r"[^a-z]+").split
MARKS = re.compile(r"[.,;:!?]")
_named: dict[str, int] = {}


def named(names: str) -> int:
    """The groups of an attribute's words as bits."""
    if not names:
        return 0
    bits = _named.get(names)
    if bits is None:
        bits = 0
        for w in SPLIT(names):
            bits |= WORD_OF.get(w, 0)
        if len(_named) > 10_000:
            _named.clear()
        _named[names] = bits
    return bits


N_WORDS = len(WORD_GROUPS)
N_NUMBERS = 20
N_FEATURES = len(TAG_GROUPS) + 2 * N_WORDS + 16 + N_NUMBERS


def columns(page: Page) -> tuple[list[list], int]:
    """Per-node lists from which the features of many pages are computed at once."""
    tags, parents = page.tags, page.parents
    n = len(tags)
    chars, link_chars, marks, elements, runs, links = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    depth, rank, kids, own, above, above_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    group = [TAG_OF.get(t, -1) for t in tags]
    for i in range(1, n):
        up = parents[i]
        depth[i] = depth[up] + 1
        rank[i] = kids[up]
        kids[up] += 1
        own[i] = named(page.names[i])
        above[i] = above[up] | own[up]
        above_tags[i] = above_tags[up] | (1 << group[up] if group[up] >= 0 else 0)
    link = 1 << TAG_OF["a"]
    for i in range(n - 1, -1, -1):
        tag = tags[i]
        if tag == TEXT:
            text = page.texts[i]
            chars[i] = len(text)
            marks[i] = len(MARKS.findall(text))
            runs[i] = 1
            elements[i] = 0
            if above_tags[i] & link:
                link_chars[i] = chars[i]
        elif tag == " ":
            elements[i] = 0
        elif tag == "a":
            links[i] += 1
        up = parents[i]
        if up >= 0:
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            marks[up] += marks[i]
            elements[up] += elements[i]
            runs[up] += runs[i]
            links[up] += links[i]
    return [group, own, above, above_tags, depth, rank, kids, chars, link_chars, marks, elements, runs, links, parents], n


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all nodes of all pages, their parents (global numbers, -1 for roots) and each page's first node."""
    parts = [columns(p) for p in pages]
    sizes = np.array([n for _, n in parts])
    first = np.cumsum(sizes) - sizes
    flat = [np.array([v for cols, _ in parts for v in cols[k]], np.int64) for k in range(14)]
    group, own, above, above_tags, depth, rank, kids, chars, link_chars, marks, elements, runs, links, parent = flat
    page = np.repeat(np.arange(len(pages)), sizes)
    up = np.where(parent >= 0, parent + first[page], np.arange(len(parent)))
    total = chars[first][page]
    root_runs = runs[first][page]
    place = np.arange(len(page)) - first[page]
    out = np.zeros((len(page), N_FEATURES), np.float32)
    for g in range(len(TAG_GROUPS)):
        out[:, g] = group == g
    at = len(TAG_GROUPS)
    for w in range(N_WORDS):
        out[:, at + w] = own >> w & 1
        out[:, at + N_WORDS + w] = above >> w & 1
    at += 2 * N_WORDS
    for g in range(16):
        out[:, at + g] = above_tags >> g & 1
    at += 16
    safe = lambda a, b: a / np.maximum(b, 1)
    before = np.zeros(len(page))
    running = np.cumsum(np.where(group == TAG_OF[TEXT], chars, 0))
    before = running - np.where(group == TAG_OF[TEXT], chars, 0)
    before = before - before[first][page]
    numbers = [
        depth,
        rank,
        safe(rank, kids[up] - 1),
        kids,
        kids[up],
        np.log1p(chars),
        np.log1p(chars[up]),
        safe(chars, total),
        safe(chars, chars[up]),
        safe(link_chars, chars),
        safe(link_chars[up], chars[up]),
        safe(marks, chars) * 100,
        safe(marks[up], chars[up]) * 100,
        np.log1p(safe(chars, elements)),
        np.log1p(safe(chars[up], elements[up])),
        safe(chars, runs),
        np.log1p(links),
        safe(place, sizes[page]),
        safe(before, total),
        safe(runs, root_runs),
    ]
    for k, values in enumerate(numbers):
        out[:, at + k] = values
    return out, np.where(parent >= 0, up, -1), first


# ---- boosted trees -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """``sample`` pages give the text of ``pages`` training pages."""

    sample: int = 400
    pages: int = 1800
    rounds: int = 50
    depth: int = 5
    rate: float = 0.25
    bins: int = 32
    least: float = 4.0
    seed: int = 5


@dataclass
class Forest:
    """Full binary trees: per inner node a feature and a bin; a row goes right if its bin is greater. ``values`` per leaf."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left") if len(e) > 1 else (x[:, j] > e[0] if len(e) else 0)
        return out

    def log_odds(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.base)
        rows = np.arange(len(b))
        inner = self.feature.shape[1]
        for feature, cut, values in zip(self.feature, self.cut, self.values, strict=True):
            node = np.zeros(len(b), np.int64)
            while node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            total += values[node - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, s: Settings) -> Forest:
    """Gradient boosting of the logistic loss with histograms of binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner = (1 << s.depth) - 1
    forest = Forest(edges, np.zeros((s.rounds, inner), np.int64), np.full((s.rounds, inner), 255, np.int64), np.zeros((s.rounds, inner + 1)), float(np.log(p / (1 - p))))
    b = forest.binned(x)
    n_features = x.shape[1]
    offset = np.arange(n_features) * s.bins
    score = np.full(len(y), forest.base)
    for r in range(s.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(s.depth):
            start, width = (1 << level) - 1, 1 << level
            size = width * n_features * s.bins
            place = ((node - start)[:, None] * (n_features * s.bins) + offset + b).ravel()
            sums = [np.bincount(place, np.repeat(v, n_features), size).reshape(width, n_features, s.bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(v, axis=2) for v in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            gain[(left_h < s.least) | (all_h - left_h < s.least)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(width), best] > 1e-6
            forest.feature[r, start : start + width] = np.where(good, best // s.bins, 0)
            forest.cut[r, start : start + width] = np.where(good, best % s.bins, 255)
            node = 2 * node + 1 + (b[np.arange(len(y)), forest.feature[r, node]] > forest.cut[r, node])
        leaf = node - inner
        up, down = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        forest.values[r] = s.rate * up / (down + 1)
        score += forest.values[r][leaf]
    return forest


# ---- decoding ------------------------------------------------------------------------------------------------------


def decode(odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The most probable labels in which a node holds main text only if its parent does.

    Parents come before their children. ``gain`` is what the best labelling of a subtree with its root in is worth above
    leaving the whole subtree out.
    """
    gain = odds.tolist()
    up = parent.tolist()
    for i in range(len(gain) - 1, -1, -1):
        if gain[i] > 0 and up[i] >= 0:
            gain[up[i]] += gain[i]
    keep = [False] * len(gain)
    for i, g in enumerate(gain):
        keep[i] = g > 0 and (up[i] < 0 or keep[up[i]])
    return np.array(keep)


def main_text(page: Page, keep: list[bool]) -> str:
    """The kept text runs as blocks, in page order."""
    blocks: list[str] = []
    run: list[str] = []
    last = -1  # the block element that the open run belongs to

    def close() -> None:
        if run and (text := " ".join("".join(run).split())):
            blocks.append(text)
        run.clear()

    block_of = [0] * len(page.tags)
    for i, tag in enumerate(page.tags):
        up = page.parents[i]
        block_of[i] = i if tag in BLOCKS else (block_of[up] if up >= 0 else 0)
        if tag in BLOCKS:
            close()
            last = i
        elif tag in (TEXT, " "):
            if block_of[i] != last:
                close()
                last = block_of[i]
            if tag == " " or keep[i]:
                run.append(page.texts[i])
        elif tag == "br":
            run.append(" ")
    close()
    return "\n\n".join(blocks)


def extract(pages: list[Page], forest: Forest) -> list[str]:
    x, parent, first = features(pages)
    keep = decode(forest.log_odds(forest.binned(x)), parent).tolist()
    ends = [*first[1:].tolist(), len(keep)]
    return [main_text(p, keep[a:b]) for p, a, b in zip(pages, first.tolist(), ends, strict=True)]


# ---- training pages ------------------------------------------------------------------------------------------------


class Maker:
    """Pages assembled from sentences, with a label for every piece of text: U+0001 starts main text, U+0002 other text."""

    def __init__(self, sentences: list[str], rng: np.random.Generator):
        self.sentences, self.rng = sentences, rng

    def pick(self, *values):
        return values[self.rng.integers(len(values))]

    def words(self, low: int, high: int) -> str:
        text = self.sentences[self.rng.integers(len(self.sentences))].split()
        return " ".join(text[: self.rng.integers(low, high + 1)]) or "x"

    def prose(self, low: int, high: int, mark: str) -> str:
        count = self.rng.integers(low, high + 1)
        return mark + escape(" ".join(self.sentences[self.rng.integers(len(self.sentences))] for _ in range(count)))

    def box(self, tag: str, names: tuple[str, ...], inside: str, bare: float = 0.12) -> str:
        """A semantic element, a named container, or, rarely, a bare one."""
        draw = self.rng.random()
        if tag and draw < 0.45:
            return f"<{tag}>{inside}</{tag}>"
        if draw < 1 - bare:
            name = self.pick(*names)
            name = self.pick(name, f"{name}-box", f"site-{name}", f"{name} wide", f"{name}1")
            kind = self.pick("class", "class", "id")
            where = self.pick("div", "div", "section", tag or "div")
            return f'<{where} {kind}="{name}">{inside}</{where}>'
        return f"<div>{inside}</div>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/x{i}">\x02{escape(self.words(1, 4))}</a>' for i in range(self.rng.integers(low, high + 1))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items)

    def para(self, text: str) -> str:
        return f"<p>{text}" if self.rng.random() < 0.15 else f"<p>{text}</p>"

    def menu(self) -> str:
        return self.box("nav", WORD_GROUPS[1], self.links(3, 9), 0.2)

    def head(self) -> str:
        title = f"<{self.pick('h1', 'h2', 'div')}>\x02{escape(self.words(1, 5))}</{'x'}>"
        title = re.sub(r"<(\w+)>(.*)</x>", r"<\1>\2</\1>", title, flags=re.S)
        more = self.para(self.prose(1, 1, "\x02")) if self.rng.random() < 0.4 else ""
        return self.box("header", WORD_GROUPS[2], title + more + (self.menu() if self.rng.random() < 0.3 else ""))

    def foot(self) -> str:
        body = self.pick("", "<p>") + "\x02&copy; " + escape(self.words(2, 12)) + self.pick("", " &middot; " + escape(self.words(3, 40)))
        return self.box("footer", WORD_GROUPS[3], body + (self.links(2, 5) if self.rng.random() < 0.4 else ""))

    def side(self) -> str:
        inside = f"<h3>\x02{escape(self.words(1, 4))}</h3>" + self.pick(self.links(2, 8), self.para(self.prose(1, 3, "\x02")))
        return self.box("aside", WORD_GROUPS[4], inside)

    def notice(self) -> str:
        return self.box("", WORD_GROUPS[5], self.pick(self.para(self.prose(1, 2, "\x02")), self.prose(1, 2, "\x02")) + self.pick("", "<button>\x02OK</button>"), 0.05)

    def advert(self) -> str:
        text = self.pick(self.prose(1, 1, "\x02"), self.para(self.prose(1, 2, "\x02")), "\x02" + escape(self.words(2, 8)))
        return f"<!-- ad {self.rng.integers(99)} -->" * int(self.rng.integers(2)) + self.box(self.pick("", "aside"), WORD_GROUPS[6], text, 0.05)

    def form(self) -> str:
        fields = "".join(f"<label>\x02{escape(self.words(1, 4))}</label><input name=a>" for _ in range(self.rng.integers(1, 4)))
        inside = f"<form>{self.pick('', self.para(self.prose(1, 1, chr(2))))}{fields}<button>\x02{escape(self.words(1, 2))}</button></form>"
        return self.pick(inside, self.box("", WORD_GROUPS[7], inside, 0.05))

    def comments(self) -> str:
        one = lambda: self.box("article", ("comment", "reply"), f"<b>\x02{escape(self.words(1, 2))}</b>" + self.para(self.prose(1, 3, "\x02")), 0.1)
        title = f"<h3>\x02{escape(self.words(1, 3))}</h3>" if self.rng.random() < 0.7 else ""
        return self.box("", WORD_GROUPS[8], title + "".join(one() for _ in range(self.rng.integers(1, 6))), 0.02)

    def article(self) -> str:
        out = [f"<h1>\x01{escape(self.words(3, 12))}</h1>"] if self.rng.random() < 0.85 else []
        if self.rng.random() < 0.25:  # next to nothing to say
            text = "\x01" + escape(self.words(3, 14))
            return self.box(self.pick("article", "article", "main"), WORD_GROUPS[0], "".join(out) + self.para(self.pick(text, f"<b>{text}<br>")), 0.05)
        for _ in range(self.rng.integers(1, 9)):
            draw = self.rng.random()
            if draw < 0.72:
                text = self.prose(1, 8, "\x01")
                if self.rng.random() < 0.3:
                    text = "<b>" + text + self.pick("</b>", "") + self.pick("", "<br>")
                if self.rng.random() < 0.2:
                    text += f' <a href="/y">\x01{escape(self.words(1, 5))}</a> ' + self.prose(1, 1, "\x01")
                out.append(self.para(text))
            elif draw < 0.8:
                out.append(f"<h2>\x01{escape(self.words(1, 7))}</h2>")
            elif draw < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2, chr(1))}</li>" for _ in range(self.rng.integers(2, 6))) + "</ul>")
            elif draw < 0.9:
                out.append(f"<blockquote>{self.prose(1, 3, chr(1))}</blockquote>")
            elif draw < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.prose(1, 1, chr(1))}</td></tr>" for _ in range(self.rng.integers(1, 4))) + "</table>")
            else:
                out.append(self.pick(self.advert, self.side, self.form)())
        return self.box(self.pick("article", "article", "main"), WORD_GROUPS[0], "".join(out), 0.2)

    def page(self) -> str:
        chance = lambda p, f: f() if self.rng.random() < p else ""
        before = [chance(0.5, self.head), chance(0.8, self.menu), chance(0.35, self.notice), chance(0.5, self.advert), chance(0.2, self.form)]
        after = [chance(0.35, self.side), chance(0.3, self.comments), chance(0.25, self.form), chance(0.2, self.advert), chance(0.15, self.notice), chance(0.85, self.foot)]
        left = chance(0.25, self.side)
        centre = left + self.article()
        if self.rng.random() < 0.35:
            centre += chance(0.4, self.comments) + chance(0.4, self.side)
            centre = f'<div{self.pick("", " class=wrapper", " id=page", " class=container")}>{centre}</div>'
        if self.rng.random() < 0.2:
            centre = f"<main>{centre}</main>"
        return "<html><head><title>t</title></head><body>" + "".join(before) + centre + "".join(after) + "</body></html>"


def labelled(page: Page) -> np.ndarray:
    """1 for text runs of main text and all nodes above them; the marks are removed from the text."""
    y = np.zeros(len(page.tags))
    for i in range(len(page.tags) - 1, -1, -1):
        text = page.texts[i]
        if text:
            y[i] = "\x01" in text
            page.texts[i] = text.replace("\x01", "").replace("\x02", "")
        if y[i] and page.parents[i] >= 0:
            y[page.parents[i]] = 1
    return y


def train(htmls: list[str], s: Settings) -> Forest:
    """A forest from pages made around the sentences of ``htmls``."""
    rng = np.random.default_rng(s.seed)
    sentences = []
    for html in htmls:
        page = parse(html or "")
        for text in page.texts:
            sentences += [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if 2 < len(x) < 2000]
    maker = Maker(sentences or ["Words of a sentence, in a row.", "Some more of them."], rng)
    pages = [parse(maker.page()) for _ in range(s.pages)]
    y = np.concatenate([labelled(p) for p in pages])
    return boost(features(pages)[0], y, s)


# ---- Spark ---------------------------------------------------------------------------------------------------------


def fit(pages: DataFrame, s: Settings | None = None, key: str = "page_id", html: str = "html") -> Forest:
    """Trained on text of about ``sample`` pages, chosen by a hash of the id."""
    s = s or Settings()
    n = pages.count()
    part = min(1_000_000, -(-1_000_000 * s.sample // max(n, 1)))
    drawn = F.pmod(F.xxhash64(F.lit(s.seed), F.col(key).cast("string")), F.lit(1_000_000)) < part
    rows = pages.filter(drawn).select(F.col(key).cast("string").alias("k"), F.col(html).alias("h")).toArrow().sort_by([("k", "ascending"), ("h", "ascending")])
    return train(rows.column("h").to_pylist(), s)


def extracted(html: Column, forest: Forest, spark) -> Column:
    """The main text of each page."""
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 256):
                out += extract([parse(h.as_py() or "") for h in batch.slice(at, 256)], shared.value)
            yield pa.array(out, pa.string())

    return texts(html)
