"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

A page is parsed into a tree (character references decoded, scripts, styles and comments dropped,
unclosed paragraphs closed by the next block). Each element is described by its tag, the words in its
class, id and role, depth, text and link densities of its subtree and its siblings. Trees boosted on
generated pages with known articles give each element the odds that its own text belongs to the
article; one dynamic programme over the page then picks the most likely labelling in which what lies
outside the article holds no part of it but the article itself, and what was dropped stays dropped.

Text inside one block has single spaces, blocks are joined by line breaks in page order. Null and empty
pages give an empty text; so does a page without an article. Repeated rows are extracted each; only the
three named columns are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import gbt
from .common import ship, table

#: Fixed values of the format: elements that start a block, never have content, or never show any.
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset address hr details summary dialog search center noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template head title svg annotation annotation-xml iframe canvas audio video select textarea button noscript".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
#: What a head can hold; anything else ends one that is still open.
HEAD = frozenset("base basefont bgsound link meta title style script template noscript".split())
CLOSES_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"}
#: An element that a new one of the same row closes, up to the container that bounds the search.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_SIGN = re.compile("[>\"']")
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "words", "parent", "depth", "index", "end", "chars", "links", "kids", "attrs", "gone")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None, index: int, gone: bool = False):
        self.tag, self.words, self.parent, self.index, self.gone = tag, words, parent, index, gone or tag in HIDDEN
        self.depth = parent.depth + 1 if parent else 0
        self.end, self.chars, self.links, self.kids = index + 1, 0, 0, 0


class Tags:
    """The markup of a page, piece by piece, in time linear in the page.

    A tag ends at the first > outside quotes. Where one doesn't end at all its < is text; from the first
    such place on, a table made in one pass from the back tells where a tag that gets that far ends.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.signs: list[int] | None = None

    def ends(self, at: int) -> bool:
        """Whether a tag whose name ends at ``at`` ends."""
        if self.signs is None:
            self.signs = [m.start() for m in _SIGN.finditer(self.page)]
            self.good = [False] * (len(self.signs) + 1)
            after: dict[str, int] = {}
            for k in range(len(self.signs) - 1, -1, -1):
                c = self.page[self.signs[k]]
                self.good[k] = c == ">" or c in after and self.good[after[c] + 1]
                after[c] = k
        return self.good[bisect_left(self.signs, at)]

    def walk(self, start: int) -> tuple[int, int, re.Match | None]:
        """From, to and match of the next tag, comment or declaration after ``start``; from is -1 after the last."""
        page, i, n = self.page, start, len(self.page)
        while 0 <= (i := page.find("<", i)):
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, n if end < 0 else end + 3, None
            if i >= self.last:  # no tag ends any more, only a comment can begin
                i = page.find("<!--", i)
                return (i, n, None) if i >= 0 else (-1, -1, None)
            if page.startswith(("<!", "<?"), i):
                return i, page.find(">", i) + 1, None
            if self.signs is None or self.ends(i):
                m = _OPEN.match(page, i)
                if m:
                    return i, m.end(), m
                if page[i + 1 : i + 2].isalpha() or page[i + 1 : i + 2] == "/":
                    self.ends(i)
            i += 1
        return -1, -1, None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Elements in page order, and (element, text, starts a block) for every piece of shown text."""
    nodes = [Node("html", frozenset(), None, 0)]
    pieces: list[tuple[int, str, bool]] = []
    stack = [nodes[0]]
    where: dict[str, list[int]] = {"html": [0]}  # places in the stack of the open elements of each tag
    blocks = [0]
    at, fresh, hidden = 0, True, 0
    n = len(page)
    tags = Tags(page)
    top = lambda tag: (where.get(tag) or (0,))[-1]

    def text(a: int, b: int) -> None:
        nonlocal fresh
        if stack[-1].tag == "head" and page[a:b].strip():
            close(len(stack) - 1)
        if a < b and not hidden:
            t = page[a:b]
            if "&" in t:
                t = entities.unescape(t)
            pieces.append((stack[-1].index, t, fresh))
            if t.strip():
                fresh = False

    def close(k: int) -> None:
        nonlocal hidden, fresh
        while len(stack) > k:
            node = stack.pop()
            where[node.tag].pop()
            node.end = len(nodes)
            hidden -= node.gone
            if node.tag in BLOCKS:
                blocks.pop()
                fresh = True

    while at < n:
        start = page.find("<", at)
        m = _OPEN.match(page, start) if start >= 0 and tags.signs is None else None
        if m:
            to = m.end()
        else:
            start, to, m = tags.walk(at)
            if start < 0:
                break
        text(at, start)
        at = to
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = top(tag)
            if k > 0 and (tag in BLOCKS or k > blocks[-1]):
                close(k)
            fresh = fresh or tag in BLOCKS
            continue
        if tag in ("html", "body") and where.get(tag) or tag == "head" and len(stack) > 1:
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in CLOSES_P:
            if stack[blocks[-1]].tag == "p":
                close(blocks[-1])
        elif tag in SIBLINGS:
            ends, bound = SIBLINGS[tag]
            k = max(map(top, ends))
            if k > max(map(top, bound)):
                close(k)
        if tag in VOID:
            if tag == "hr":
                fresh = True
            elif tag in ("br", "img", "wbr") and tag != "wbr" and not hidden:
                pieces.append((stack[-1].index, " ", False))
            continue
        raw = m[3]
        words: frozenset[str] = frozenset()
        gone = False
        if raw.strip(" /"):
            found = []
            for a in _ATTR.finditer(raw):
                name = a[1].lower()
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    found += _WORD.findall(a[2] or a[3] or a[4] or "")
                elif name == "hidden":
                    gone = True
                elif name == "style" and re.search(r"display\s*:\s*none", a[2] or a[3] or ""):
                    gone = True
            words = frozenset(w.lower() for w in found)
        node = Node(tag, words, stack[-1], len(nodes), gone and tag != "head")
        nodes.append(node)
        fresh = fresh or tag in BLOCKS
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or n
            node.end = len(nodes)
            continue
        if raw.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(node)
        hidden += node.gone
    text(at, n)
    close(1)
    nodes[0].end = len(nodes)
    return nodes, pieces


#: Word stems of attributes, by what they mostly mark.
LEXICON = {
    "main": ("article", "content", "main", "post", "story", "entry", "body", "text", "prose", "markdown"),
    "menu": ("nav", "menu", "breadcrumb", "toc", "tab", "pagination", "pager", "skip", "toolbar"),
    "edge": ("header", "footer", "masthead", "foot", "copyright", "legal", "topbar", "bottom"),
    "side": ("sidebar", "aside", "related", "widget", "recommend", "popular", "trending", "rail", "also"),
    "advert": ("ad", "ads", "advert", "sponsor", "promo", "banner", "affiliate", "teaser", "outbrain", "taboola"),
    "notice": ("cookie", "consent", "notice", "alert", "modal", "popup", "gdpr", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer"),
    "form": ("form", "login", "search", "input", "register", "captcha", "contact"),
    "talk": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "thread", "reader"),
    "meta": ("share", "social", "byline", "author", "tags", "meta", "follow", "timestamp", "rating"),
}
TAGS = ("article", "main", "section", "div", "p", "heading", "li", "list", "cell", "table", "quote", "nav", "header", "footer", "aside", "form", "inline", "other")
_KIND = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "li": "li", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "table": "table", "tbody": "table", "tr": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote"}
_LEX = list(LEXICON)
FEATURES = ("tag", *[f"own_{k}" for k in _LEX], *[f"above_{k}" for k in _LEX], "in_article", "in_main", "in_edge", "depth", "log_chars", "share", "links", "kids", "place", "siblings", "sibling_share", "log_own", "paragraphs", "has_below", "is_landmark")


def lexical(words: frozenset[str]) -> list[float]:
    return [float(any(w in stems or w.rstrip("s") in stems for w in words)) for stems in LEXICON.values()] if words else [0.0] * len(_LEX)


def inline(node: Node, flags: np.ndarray) -> bool:
    """Whether an element goes where its block goes: no block itself, and no word in it that says otherwise."""
    return node.tag not in BLOCKS and not flags[1:].any()


def described(nodes: list[Node], pieces: list[tuple[int, str, bool]]) -> np.ndarray:
    """A row of FEATURES for each element."""
    n = len(nodes)
    own, linked, paras = np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = [False] * n
    parent = np.zeros(n, dtype=np.int64)
    kids = np.zeros(n)
    place = np.zeros(n)
    flags = np.zeros((n, len(_LEX)))
    above = np.zeros((n, len(_LEX)))
    held = np.zeros((n, 3))
    tags = np.zeros(n)
    below = np.zeros(n)
    for node in nodes[1:]:
        i, p = node.index, node.parent.index
        parent[i] = p
        in_link[i] = in_link[p] or node.tag == "a"
        place[i] = kids[p]
        kids[p] += 1
        if node.words:
            flags[i] = lexical(node.words)
        t = node.tag
        above[i] = np.maximum(above[p], flags[p]) if flags[p].any() else above[p]
        held[i] = held[p]
        q = nodes[p].tag
        if q == "article":
            held[i, 0] = 1
        elif q == "main":
            held[i, 1] = 1
        elif q in ("nav", "header", "footer", "aside", "form"):
            held[i, 2] = 1
        tags[i] = TAGS.index(t) if t in TAGS else TAGS.index(_KIND.get(t, "inline" if t not in BLOCKS else "other"))
        paras[i] = t == "p"
        below[i] = t in ("article", "main")
    for i, t, _ in pieces:
        c = len(t.strip())
        own[i] += c
        if in_link[i]:
            linked[i] += c
    total, link, para, has = own.copy(), linked.copy(), paras.copy(), below.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        link[p] += link[i]
        para[p] += para[i]
        has[p] += has[i]
    all_ = max(total[0], 1)
    for i in range(n - 1, 0, -1):  # the text of plain inline elements is their block's
        if inline(nodes[i], flags[i]):
            own[parent[i]] += own[i]
            own[i] = 0
    around = np.maximum(total[parent], 1)
    depth = np.array([x.depth for x in nodes], dtype=np.float64)
    return np.column_stack(
        [tags, flags, above, held, depth, np.log1p(total), total / all_, link / np.maximum(total, 1), kids, place, kids[parent], total / around, np.log1p(own), para, has - below, below]
    )


def decode(nodes: list[Node], odds: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Labels (in the article or not) of all elements: the most likely that don't contradict along any path.

    From the root a path is outside, may enter the article once, and may leave it once for good. Each
    state has its own sum of log-odds from below, so one pass up and one down find the best labelling.
    Elements that are ``bound`` are in their parent's state.
    """
    n = len(nodes)
    gain = np.where(bound, 0.0, odds * weight)
    best = np.zeros((n, 3))  # outside, inside, dropped
    best[:, 1] = gain
    choice = np.zeros((n, 2), dtype=np.int8)
    enter, leave = -3.0, -0.5  # an entry has to be worth more than one weak element
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        o, k, d = best[i]
        if bound[i]:
            best[p] += best[i]
            continue
        choice[i, 0] = k + enter > o
        best[p, 0] += max(o, k + enter)
        choice[i, 1] = d + leave > k
        best[p, 1] += max(k, d + leave)
        best[p, 2] += d
    state = np.zeros(n, dtype=np.int8)
    state[0] = best[0, 1] + enter > best[0, 0]
    for i in range(1, n):
        s = state[nodes[i].parent.index]
        state[i] = (1 if choice[i, 0] else 0) if s == 0 else (2 if choice[i, 1] else 1) if s == 1 else 2
    return state == 1


def text_of(nodes: list[Node], pieces: list[tuple[int, str, bool]], kept: np.ndarray) -> str:
    """The kept text: blocks joined by line breaks, white space inside a block as one space."""
    blocks: list[str] = []
    now: list[str] = []
    for i, t, fresh in pieces:
        if fresh and now:
            blocks.append("".join(now))
            now = []
        if kept[i]:
            now.append(t)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


# ---- generated pages ------------------------------------------------------------------------------


@dataclass
class Maker:
    """Makes pages whose elements are marked: data-k="1" is article, "0" is not."""

    r: random.Random
    out: list[str] = field(default_factory=list)

    def words(self, n: int) -> str:
        w = ["".join(self.r.choice(("ka", "to", "mi", "re", "sul", "ben", "or", "it", "va", "es", "um")) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        return " ".join(w).capitalize() + self.r.choice((".", "", "?", "!"))

    def tag(self, name: str, k: int, inner: str, attrs: str = "") -> str:
        return f'<{name} data-k="{k}"{attrs}>{inner}</{name}>'

    def cls(self, *stems: str) -> str:
        v = self.r.choice(stems)
        v = self.r.choice((v, f"{v}-box", f"site-{v}", f"{v} wide", f"{v}_{self.r.randint(1, 9)}"))
        return self.r.choice((f' class="{v}"', f' class="{v}"', f' id="{v}"'))

    def links(self, n: int, k: int = 0) -> str:
        return "".join(self.r.choice((lambda x: self.tag("li", k, x), lambda x: x))(self.tag("a", k, self.words(self.r.randint(1, 3)), ' href="/x"')) for _ in range(n))

    def junk(self) -> str:
        r = self.r
        kind = r.choice(("menu", "edge", "side", "advert", "notice", "form", "talk", "meta"))
        name = {"menu": ("nav", "nav", "div", "ul"), "edge": ("header", "footer", "footer", "div"), "side": ("aside", "div", "section"), "form": ("form", "div")}.get(kind, ("div", "div", "section", "aside"))
        name = r.choice(name)
        plain = name in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        attrs = "" if plain else self.cls(*LEXICON[kind])
        if kind == "menu":
            inner = self.links(r.randint(2, 9))
            inner = self.tag("ul", 0, inner) if r.random() < 0.6 and name != "ul" else inner
        elif kind == "talk":
            inner = self.tag("h3", 0, self.words(2)) + "".join(self.tag("div", 0, self.tag("p", 0, self.words(r.randint(4, 50))), self.cls("comment", "reply")) for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = self.tag("label", 0, self.words(2)) + '<input name="q">' + self.tag("p", 0, self.words(r.randint(3, 20))) * (r.random() < 0.4)
        elif kind == "side":
            inner = self.tag("h3", 0, self.words(2)) + r.choice((lambda: self.tag("ul", 0, self.links(r.randint(2, 8))), lambda: self.tag("p", 0, self.words(r.randint(5, 60)))))()
        else:
            inner = r.choice((lambda: self.words(r.randint(3, 40)), lambda: self.tag("p", 0, self.words(r.randint(3, 60))), lambda: "&copy; " + self.words(r.randint(2, 12)) + self.links(r.randint(0, 3)), lambda: self.tag("span", 0, self.words(r.randint(2, 20)))))()
        return self.tag(name, 0, inner, attrs)

    def part(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            inner = self.words(r.choice((2, 5, 12, 30, 60, 120)))
            if r.random() < 0.25:
                inner += self.tag(r.choice(("b", "em", "a", "span")), 1, self.words(3)) + self.words(4)
            return self.tag("p", 1, inner)
        if kind < 0.74:
            return self.tag(r.choice(("h2", "h3")), 1, self.words(r.randint(1, 8)))
        if kind < 0.82:
            return self.tag(r.choice(("ul", "ol")), 1, "".join(self.tag("li", 1, self.words(r.randint(2, 20))) for _ in range(r.randint(2, 5))))
        if kind < 0.87:
            return self.tag("blockquote", 1, self.tag("p", 1, self.words(r.randint(5, 30))))
        if kind < 0.91:
            return self.tag("table", 1, "".join(self.tag("tr", 1, "".join(self.tag("td", 1, self.words(2)) for _ in range(3))) for _ in range(r.randint(2, 4))))
        if kind < 0.95:
            return self.tag("figure", 1, "<img src=x>" + self.tag("figcaption", 1, self.words(6)))
        return self.tag("div", 1, self.tag("p", 1, self.words(20)))

    def page(self) -> str:
        r = self.r
        inner = self.tag("h1", 1, self.words(r.randint(2, 12))) if r.random() < 0.8 else ""
        if r.random() < 0.15:
            inner = self.tag("header", 1, inner or self.tag("h1", 1, self.words(5)))
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            inner += self.part()
            if r.random() < 0.12:
                inner += self.junk()
        shape = r.random()
        if shape < 0.5:
            body = self.tag("article", 1, inner, r.choice(("", "", self.cls("post", "story"))))
        elif shape < 0.65:
            body = self.tag("main", 1, inner)
        elif shape < 0.9:
            body = self.tag("div", 1, inner, self.cls(*LEXICON["main"]))
        else:
            body = self.tag("div", 1, inner)
        if r.random() < 0.35:
            body = self.tag(r.choice(("main", "div", "section")), 0, body + (self.junk() if r.random() < 0.5 else ""), r.choice(("", ' class="wrap"', ' id="page"')))
        before = "".join(self.junk() for _ in range(r.randint(0, 3)))
        after = "".join(self.junk() for _ in range(r.randint(0, 4)))
        return f"<html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"


@dataclass(frozen=True)
class HtmlConfig:
    pages: int = 400
    seed: int = 11
    trees: int = 40
    depth: int = 4


_MARK = re.compile(r' data-k="([01])"')
_MODELS: dict[HtmlConfig, gbt.Gbt] = {}


def examples(cfg: HtmlConfig) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of generated pages."""
    make = Maker(random.Random(cfg.seed))
    xs, ys = [], []
    for _ in range(cfg.pages):
        page = make.page()
        marks = [int(m[1]) for m in _MARK.finditer(page)]
        tags = re.findall(r'<([a-z0-9]+) data-k="[01]"', page)
        nodes, pieces = parse(_MARK.sub("", page))
        x = described(nodes, pieces)
        k = 0
        for node in nodes:
            if k < len(tags) and node.tag == tags[k]:
                xs.append(x[node.index])
                ys.append(marks[k])
                k += 1
    return np.array(xs), np.array(ys, dtype=np.float64)


def trained(cfg: HtmlConfig = HtmlConfig()) -> gbt.Gbt:
    if cfg not in _MODELS:
        _MODELS[cfg] = gbt.fit(*examples(cfg), gbt.GbtConfig(trees=cfg.trees, depth=cfg.depth))
    return _MODELS[cfg]


def extract_all(pages: list[str | None], model: gbt.Gbt) -> list[str]:
    """The main text of each page; the trees see all their elements at once."""
    parsed = [parse(p) if p else ([], []) for p in pages]
    xs = [described(n, s) if n else np.zeros((0, len(FEATURES))) for n, s in parsed]
    odds = np.clip(model.margin(np.concatenate(xs)), -6, 6) if xs else np.zeros(0)
    out, at = [], 0
    for (nodes, pieces), x in zip(parsed, xs, strict=True):
        if not nodes:
            out.append("")
            continue
        own = np.expm1(x[:, FEATURES.index("log_own")])
        weight = np.where(own > 0, 1 + np.log1p(own) / 4, 0.5)
        weight[0] = 0.0
        flags = x[:, 1 : 1 + len(_LEX)]
        bound = np.array([inline(node, f) for node, f in zip(nodes, flags, strict=True)])
        kept = decode(nodes, odds[at : at + len(nodes)], weight, bound)
        at += len(nodes)
        out.append(text_of(nodes, pieces, kept))
    return out


def extract(pages: DataFrame, cfg: HtmlConfig = HtmlConfig()) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained(cfg))

    def run(batches):
        m = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                b = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(extract_all(b.column(2).to_pylist(), m), pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")
