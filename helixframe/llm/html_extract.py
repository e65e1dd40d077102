"""HTML main-text extraction: gradient-boosted trees over DOM-node features, decoded top-down.

Each page is parsed into a tree of elements (the parser closes what browsers would close).  Every
element gets features of its subtree (text, link and markup density), its attribute tokens,
depth, form controls and siblings.  Boosted regression trees, trained here on generated pages of many
layouts, score an element, inline ones too, as content or not.  Decoding is hierarchical: probabilities are
combined down the tree, an element below a rejected one is never kept, and an article that is kept
is rejected again only below a child that the model clearly rejects, so ancestors and
descendants never contradict each other.

The text keeps the blocks of the kept elements in page order: character references decoded,
white space inside a block made one space, blocks joined by an empty line.

Edge cases: null, empty and markup-free html are handled (plain text is one block); unclosed
and stray tags follow browsers' habits; scripts, styles, comments and templates are
never text; repeated pages are extracted each; other columns are ignored.  Time and memory are linear
in a page's tags, some 500 bytes for each; a very long page is handled whole by its task.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

#: As browsers read tags: a quote opens a value only right after "=", elsewhere it is a sign like others.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that browsers show no running text of.
DEAD = frozenset("script style noscript template iframe head title textarea select option button input svg canvas object audio video xmp noembed noframes".split())
CONTROLS = frozenset("input select textarea button option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BLOCK_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_FENCE = frozenset("ul ol dl table article section div main aside nav header footer body html td th blockquote form".split())

#: Words in class and id values: of boilerplate, and of content.
BAD_TOKENS = frozenset("ad ads advert advertisement adsense banner sponsor sponsored promo promoted nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside rail widget related recommend recommended share sharing social follow subscribe newsletter signup login cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond disqus discussion form search pagination pager tags tagcloud copyright legal disclaimer skip toolbar hidden".split())
GOOD_TOKENS = frozenset("article content contents post entry story body text main articlebody prose page hentry blog news paragraph lead".split())
TAGS = ("html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "figure", "dl", "span", "details", "a", "menu", "dialog")
_TAG = {t: i for i, t in enumerate(TAGS)}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "depth", "text", "links", "punct", "tags", "words", "controls", "place", "among", "alike")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.text = self.links = self.punct = self.tags = self.words = 0
        self.controls = int(tag in CONTROLS)
        self.place, self.among, self.alike = 0, 1, 1  # among its siblings


def parse(page: str) -> Node:
    """The element tree; texts are strings among the children."""
    root = Node("html", "", None)
    now, at, end = root, 0, len(page)
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            now.kids.append(page[at : m.start()])
        at = m.end()
        close, tag = m.group(1), m.group(2)
        if close:
            close = close.lower()
            up = now
            while up is not root and up.tag != close:
                if up.tag in _FENCE and close in INLINE:
                    up = root  # a stray inline end doesn't close blocks
                    break
                up = up.parent
            if up is not root:
                now = up.parent
        elif tag:
            tag = tag.lower()
            if tag in ("html", "body") and now is root:
                now.attrs += m.group(3) or ""
                continue
            if tag in _BLOCK_CLOSES_P or tag in _CLOSES:
                # inline elements left open end with the paragraph
                up = now
                while up is not root and up.tag in INLINE:
                    up = up.parent
                if up.tag == "p":
                    now = up.parent
                elif tag in _CLOSES:
                    if up.tag in _CLOSES[tag]:
                        while up is not root and up.tag in _CLOSES[tag]:
                            up = up.parent
                        now = up
            if tag == "body":
                while now is not root:
                    now = now.parent
                continue
            node = Node(tag, m.group(3) or "", now)
            now.kids.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                inner = page[at : stop.start()] if stop else page[at:]
                node.kids.append(inner)
                at = page.find(">", stop.start()) + 1 if stop else end
                at = at or end
            elif tag not in VOID and not (m.group(3) or "").endswith("/"):
                now = node
    if at < end:
        now.kids.append(page[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Elements in page order, with the sums of their subtrees."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        if n.tag not in DEAD:
            stack.extend(k for k in reversed(n.kids) if not isinstance(k, str))
    for n in reversed(order):
        n.tags += 1
        if n.tag not in DEAD:
            for k in n.kids:
                if isinstance(k, str):
                    size = len(k) - k.count(" ") - k.count("\n")
                    n.text += size
                    n.words += k.count(" ")
                    n.punct += k.count(".") + k.count(",") + k.count(";") + k.count("?") + k.count("!")
        if n.tag == "a":
            n.links = n.text
        if n.parent is not None:
            for f in ("text", "links", "punct", "tags", "words", "controls"):
                setattr(n.parent, f, getattr(n.parent, f) + getattr(n, f))
    return order


def _tokens(attrs: str) -> tuple[int, int, int]:
    if not attrs:
        return 0, 0, 0
    bad = good = hidden = 0
    for m in _ATTR.finditer(attrs):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
                bad += w in BAD_TOKENS or w in ("contentinfo", "complementary", "search", "dialog")
                good += w in GOOD_TOKENS
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = 1
    return bad, good, hidden


FEATURES = len(TAGS) + 1 + 23


def features(order: list[Node]) -> np.ndarray:
    """One row for each element."""
    out = np.zeros((len(order), FEATURES), np.float32)
    whole = max(1, order[0].text)
    base = len(TAGS) + 1
    bad_above: dict[int, int] = {}
    for i, n in enumerate(order):
        row = out[i]
        row[_TAG.get(n.tag, len(TAGS))] = 1
        bad, good, hidden = _tokens(n.attrs)
        up = n.parent
        above = bad_above.get(id(up), 0) if up is not None else 0
        bad_above[id(n)] = above + (bad > 0 or n.tag in ("nav", "footer", "aside", "form"))
        kids = [k for k in n.kids if not isinstance(k, str)]
        tags = Counter(k.tag for k in kids)
        for j, k in enumerate(kids):
            k.place, k.among, k.alike = j, len(kids), tags[k.tag]
        row[base:] = (
            np.log1p(n.text), n.text / n.tags, n.links / max(1, n.text), n.punct / max(1, n.words + 1), n.words / max(1, n.tags),
            n.text / whole, n.depth, len(kids), bad, good, hidden, above, n.among, n.place / n.among, n.text / max(1, up.text if up else n.text),
            n.alike / n.among, bool(up and up.tag == "article"), bool(up and up.tag in ("body", "html")),
            np.log1p(n.punct), tags["p"], n.controls, n.controls / (1 + n.words), n.tag in INLINE,
        )
    return out


class Boosted:
    """Gradient-boosted trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 32, share: float = 0.5):
        self.rounds, self.depth, self.rate, self.bins, self.share = rounds, depth, rate, bins, share
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = [np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)]
        f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.base = float(f[0])
        rng = np.random.default_rng(SEED)
        use = np.flatnonzero([len(e) > 0 for e in self.edges])
        for _ in range(self.rounds):
            tried = rng.permutation(use)[: max(1, round(self.share * len(use)))]  # each tree sees a share of the features
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feat, cut, leaf = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1), np.zeros(2**self.depth)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                gs, hs = (np.bincount(node, v, n)[:, None] for v in (g, h))
                best = np.where(np.bincount(node, minlength=n) >= 20, 1e-6, np.inf)
                for j in tried.tolist():
                    m = len(self.edges[j]) + 1
                    cell = node * m + b[j]
                    gl, hl = (np.cumsum(np.bincount(cell, v, n * m).reshape(n, m), axis=1)[:, :-1] for v in (g, h))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    t = gain.argmax(1)
                    top = gain[np.arange(n), t]
                    better = top > best
                    best[better], feat[first : first + n][better], cut[first : first + n][better] = top[better], j, self.edges[j][t[better]]
                node = self._step(x, node, first, feat, cut)
            leaf = self.rate * np.bincount(node, g, len(leaf)) / (np.bincount(node, h, len(leaf)) + 1)
            f += leaf[node]
            self.trees.append((feat, cut, leaf))
        return self

    @staticmethod
    def _step(x: np.ndarray, node: np.ndarray, first: int, feat: np.ndarray, cut: np.ndarray) -> np.ndarray:
        j = feat[first + node]
        right = (j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > cut[first + node])
        return node * 2 + right

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                node = self._step(x, node, 2**level - 1, feat, cut)
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


def _prose(rng: random.Random, words: int) -> str:
    """Words in one of several manners: prose, lists of words, loops, shouting, symbols, figures."""
    manner, out = rng.random(), []
    stops = rng.choice((0.0, 0.1, 0.33, 0.5))
    tail = rng.choice(("", "", "", "!!", "&amp;", "%%%", "***"))
    word = ""
    for _ in range(words):
        if manner > 0.15 or not word:
            word = "".join(rng.choice("bcdfghklmnprstvwzé") + rng.choice("aeiouü") for _ in range(rng.randint(1, 4)))
        if manner > 0.95:
            word = str(rng.randint(1, 10**9))
        out.append((word.upper() if manner > 0.85 else word) + tail + (rng.choice(",.") if rng.random() < stops else ""))
    return " ".join(out).capitalize() + ("." if stops else "")


def generated(rng: random.Random) -> str:
    """A page of a random layout; elements carry data-truth="1" (content) or "0"."""
    t, f = ' data-truth="1"', ' data-truth="0"'

    def links(n: int) -> str:
        return "".join(f'<li{f}><a{f} href="/x">{_prose(rng, rng.randint(1, 3))[:-1]}</a></li>' for _ in range(n))

    def junk(kind: str) -> str:
        cls = lambda *c: f' class="{rng.choice(c)}"' if rng.random() < 0.9 else f' id="{rng.choice(c)}"'
        if kind == "nav":
            tag, attr = rng.choice((("nav", ""), ("div", cls("menu", "navbar", "main-nav", "navigation")), ("nav", cls("nav", "menu")), ("ul", cls("menu", "nav-list")), ("menu", cls("menu", "toolbar"))))
            body = f"<ul{f}>{links(rng.randint(2, 9))}</ul>" if tag not in ("ul", "menu") else links(rng.randint(2, 9))
        elif kind == "header":
            tag, attr = rng.choice((("header", ""), ("div", cls("header", "masthead", "site-header"))))
            body = f"<div{f}>{_prose(rng, rng.randint(1, 12))}</div>" + (f"<ul{f}>{links(3)}</ul>" if rng.random() < 0.5 else "")
        elif kind == "footer":
            tag, attr = rng.choice((("footer", ""), ("div", cls("footer", "site-footer", "bottom"))))
            body = (f"<p{f}>" if rng.random() < 0.5 else "") + "&copy; example &middot; " + _prose(rng, rng.randint(2, 25))
        elif kind == "aside":
            tag, attr = rng.choice((("aside", ""), ("div", cls("sidebar", "related", "widget", "rail")), ("section", cls("related-posts", "recommended"))))
            body = f"<h3{f}>{_prose(rng, 2)}</h3><ul{f}>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else f"<p{f}>{_prose(rng, rng.randint(5, 40))}</p>"
        elif kind == "ad":
            tag, attr = rng.choice(("div", "section", "aside")), cls("ad", "ads", "advert", "banner", "sponsored", "promo")
            body = _prose(rng, rng.randint(3, 40)) if rng.random() < 0.6 else f"<p{f}>{_prose(rng, rng.randint(3, 40))}</p>"
        elif kind == "notice":
            tag, attr = rng.choice((("div", cls("cookie-notice", "cookie", "consent", "notice", "alert", "newsletter", "popup")),) * 4 + (("dialog", " open"),))
            body = f"<p{f}>{_prose(rng, rng.randint(4, 30))}</p><button>OK</button>"
        elif kind == "form":
            tag, attr = "form", rng.choice(("", "", cls("search", "login", "signup", "newsletter")))
            line = lambda: f"<label{f}>{_prose(rng, rng.randint(1, 4))}</label>" + rng.choice(("<input>", "<input type=text name=q>", "<select><option>a<option>b</select>", "<textarea></textarea>"))
            body = (f"<p{f}>{_prose(rng, rng.randint(3, 25))}</p>" if rng.random() < 0.4 else "") + "".join(line() for _ in range(rng.randint(1, 4))) + "<button>Go</button>"
        else:
            tag, attr = rng.choice(("section", "div", "ol")), cls("comments", "comment-list", "reader-comments", "discussion", "replies")
            body = "".join(f'<div{f} class="comment"><b{f}>{_prose(rng, 1)}</b><p{f}>{_prose(rng, rng.randint(5, 50))}</p></div>' for _ in range(rng.randint(1, 5)))
        return f"<{tag}{attr}{f}>{body}</{tag}>"

    def inline(words: int) -> str:
        """A paragraph's text, at times with elements in it."""
        text = _prose(rng, words)
        kind = rng.random()
        if kind < 0.12:  # left open, or a line that ends with a break
            return rng.choice((f"<b{t}>{text}<br>", f"{text}<br>", f"<i{t}>{text}", f"<span{t}>{text}", f"<strong{t}>{text}</strong><br>"))
        if words < 8 or kind < 0.65:
            return text
        parts = text.split(" ")
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(parts))
            if rng.random() < 0.75:
                tag, attr = rng.choice((("b", ""), ("em", ""), ("i", ""), ("a", ' href="/y"'), ("span", ""), ("strong", ""), ("code", ""), ("span", ' class="hl"'), ("span", ' class="name"'), ("a", ' href="http://x.org/z" class="link"')))
                parts[k] = f"<{tag}{attr}{t}>{parts[k]}</{tag}>"
            else:
                kind = rng.choice(("advert", "ad", "sponsored", "promo", "comment", "comments", "share", "notice", "tooltip related", "reply"))
                parts.insert(k, f'<{(tag := rng.choice(("span", "span", "small", "a")))} class="{kind}"{f}>{_prose(rng, rng.randint(1, 12))}</{tag}>')
        return " ".join(parts)

    def block() -> str:
        x = rng.random()
        n = rng.choice((1, 1, 2, 3, 8, 15, 30, 60, 120))
        if x < 0.66:
            return f"<p{t}>{inline(n)}" + ("</p>" if rng.random() < 0.8 else "")
        if x < 0.76:
            h = rng.choice(("h2", "h3", "h4"))
            return f"<{h}{t}>{_prose(rng, rng.randint(1, 8))}</{h}>"
        if x < 0.84:
            k = rng.choice(("ul", "ol", "ul", "ol", "menu"))
            return f"<{k}{t}>" + "".join(f"<li{t}>{_prose(rng, rng.randint(2, 20))}</li>" for _ in range(rng.randint(2, 5))) + f"</{k}>"
        if x < 0.9:
            return f"<blockquote{t}><p{t}>{_prose(rng, n)}</p></blockquote>"
        if x < 0.95:
            return f"<div{t}>{_prose(rng, n)}</div>"
        return f"<table{t}><tr{t}><td{t}>{_prose(rng, 3)}</td><td{t}>{_prose(rng, 5)}</td></tr></table>"

    inside = [block() for _ in range(rng.choice((1, 1, 1, 1, 2, 4, 8, 14, 40)))]
    head = f"<h1{t}>{_prose(rng, rng.choice((1, 1, 2, 4, 7, 10)))}</h1>" if rng.random() < 0.9 else ""
    for kind in rng.sample(("ad", "aside", "notice", "comments", "form"), rng.choice((0, 0, 0, 1, 2))):
        inside.insert(rng.randint(0, len(inside)) if kind != "comments" else len(inside), junk(kind))
    if rng.random() < 0.15:
        head = f"<header{t}>{head}</header>"
    tag, attr = rng.choice((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' class="article-body"')))
    core = f"<{tag}{attr}{t}>{head}{''.join(inside)}</{tag}>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        core = f"<{rng.choice(('div', 'main', 'section'))}{t}>{core}"
        core += f"</{core[1:].split(' ')[0]}>"
    before = [junk(k) for k in rng.sample(("nav", "header", "ad", "notice", "form"), rng.randint(0, 4))]
    after = [junk(k) for k in rng.sample(("aside", "ad", "comments", "footer", "notice", "nav"), rng.randint(0, 4))]
    page = f"{''.join(before)}{core}{''.join(after)}"
    wrap = rng.random()
    if wrap < 0.12:  # some systems put the whole page, or the article, into a form
        hidden = '<input type="hidden" name="state" value="x">' * rng.randint(0, 3)
        attr = rng.choice(('id="aspnetForm" method="post"', 'method="post" action="/"', 'id="form1"'))
        page = f"<form {attr}{t}>{hidden}{page}</form>" if wrap < 0.08 else f"{''.join(before)}<form {attr}{t}>{hidden}{core}</form>{''.join(after)}"
    return f"<html><body{t}>{page}</body></html>"


TRAIN_PAGES, SEED = 1800, 7


@lru_cache(1)
def model() -> Boosted:
    """Trained on ``TRAIN_PAGES`` generated pages; the same everywhere."""
    rng = random.Random(SEED)
    x, y = [], []
    for _ in range(TRAIN_PAGES):
        order = _measure(parse(generated(rng)))
        truth, known = [], {}
        for n in order:
            own = re.search(r'data-truth="(\d)"', n.attrs)
            truth.append(float(own.group(1)) if own else (known[id(n.parent)] if n.parent is not None else 1.0))
            known[id(n)] = truth[-1]
            n.attrs = n.attrs.replace(own.group(0), "") if own else n.attrs
        x.append(features(order))
        y += truth
    return Boosted().fit(np.concatenate(x), np.array(y))


KEEP, REJECT, DROP = 0.35, 0.25, 0.12


def decode(order: list[Node], p: np.ndarray) -> set[int]:
    """Elements (by identity) that are kept: top-down, never below a rejected one."""
    kept: set[int] = set()
    sure: dict[int, float] = {}
    for n, q in zip(order, p.tolist(), strict=True):
        if n.parent is None:
            kept.add(id(n))
            sure[id(n)] = 0.5
            continue
        if n.tag in DEAD or id(n.parent) not in kept:
            continue
        if n.tag in INLINE:  # part of its block, unless the model clearly rejects it
            if q >= DROP:
                kept.add(id(n))
                sure[id(n)] = sure[id(n.parent)]
            continue
        # inside content that the model is sure of, a part needs clear evidence to be dropped
        prior = sure[id(n.parent)]
        if q >= (KEEP if prior < 0.9 else REJECT):
            kept.add(id(n))
            sure[id(n)] = max(q, prior if n.tag not in ("div", "section") else q)
    return kept


def blocks(root: Node, kept: set[int]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        s = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
        if s:
            out.append(s)
        line.clear()

    stack: list = [root]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif id(n) in kept:
            inline = n.tag in INLINE
            if n.tag == "br":
                line.append(" ")
            if not inline:
                flush()
                stack.append(None)
            stack.extend(reversed(n.kids))
        elif n.tag not in INLINE and n.tag not in VOID:
            flush()
    flush()
    return out


def extract(page: str | None, trees: Boosted | None = None) -> list[str]:
    """The blocks of main text of one page."""
    return _extract_all([page], trees or model())[0]


def _extract_all(pages: list[str | None], trees: Boosted) -> list[list[str]]:
    roots = [parse(x) if x else None for x in pages]
    orders = [_measure(r) if r is not None else [] for r in roots]
    full = [o for o in orders if o]
    p = trees.predict(np.concatenate([features(o) for o in full])) if full else np.zeros(0)
    out, at = [], 0
    for r, o in zip(roots, orders, strict=True):
        out.append(blocks(r, decode(o, p[at : at + len(o)])) if r is not None else [])
        at += len(o)
    return out


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(model())
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                text = ["\n\n".join(x) for x in _extract_all(part.column(2).to_pylist(), held.value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extract_text(table(spark, sf_dir, "pages"))
