"""Main-text extraction with a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks (runs of text between block-level
tags). Each block has features from its ancestors (tags, words of class, id and
role) and from its text (length, links, end mark, boilerplate cues). A two-label
chain scores blocks and neighbours, and Viterbi decoding picks the labels of a page
together; the blocks labelled as content make up the text.

The chain is trained here, in numpy, on labelled pages made from a bounded sample
(``TRAIN_PAGES``) of the table itself: the blocks that HTML's own semantics settle
(inside ``article`` or ``main`` and outside ``nav``, ``footer``, ... or not) are put
into varied layouts by ``dress``, with menus, notices, adverts, forms, sidebars and
reader comments around and between them, so that their place in the page is known. Of
pages without such elements the longer texts are dressed, so every table is learnt from.

Defined results
- null, empty or text-free html: empty text.
- a page without any content block: empty text.
- unclosed and stray tags, comments and cut-off ends are read as browsers do, roughly.
- the content of ``HIDDEN`` elements (buttons, drawings, players, ...) is no main text. One
  without its own end tag hides nothing; its text is labelled like any other.
- a head that is not closed ends at the first text or element that may not stand in it.
- repeated rows are extracted each; null ids and urls stay null.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 3
TRAIN_PAGES = 200  # bound of the sample
TRAIN_CHARS = 200_000  # longer pages are extracted like any other, but not learnt from
LAYOUTS = 8  # dressed variants per sampled page
EPOCHS = 6
FEATURES = 1 << 13
PENALTY = 1e-4

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # text up to the end tag, or to the page's end
HIDDEN = frozenset("noscript template svg select object canvas audio video button".split())  # elements with content that is no main text
ALONE = frozenset(("button", "select"))  # a second one ends the first
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
# Start tags that end a foreign element they stand in, and the foreign elements in which they do not.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN_HTML = frozenset(("foreignobject", "desc"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul head".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)),
          "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
CUES = frozenset(
    "cookie cookies consent subscribe newsletter copyright reserved advertisement sponsored comment comments reply "
    "share login menu privacy terms follow".split())

# An attribute is a name with, after "=", a value in quotes or up to the next blank. A quote
# elsewhere, or one that never closes, is a character like any other.
_ATTR = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTR})*+)>?")
_COMMENT_END = re.compile("-->|(?<!<!)--!>")
_NAMED = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(r"[^\W\d_]+")


@functools.lru_cache(1 << 14)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


@dataclass
class Block:
    text: str
    features: tuple[int, ...]
    tags: frozenset[str]


@functools.lru_cache(1 << 12)
def _own_features(tag: str, attrs: str) -> frozenset[int]:
    own = {_feature(f"in:{tag}")}
    for name, a, b, c in _NAMED.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for word in _WORD.findall(a or b or c):
                own.add(_feature(f"{'role' if name.lower() == 'role' else 'class'}:{word.lower()}"))
    return frozenset(own)


class _Open:
    """An open element with what its ancestors and itself add to a block's features.

    A hidden element adds nothing. Its content is left out if its end tag comes; one that
    ends without it hides nothing, since nobody can tell how far it was meant to reach.
    """

    __slots__ = ("tag", "parent", "own", "above", "ended", "found")

    def __init__(self, tag: str, attrs: str, parent: _Open | None, hidden: bool = False):
        self.tag, self.parent = tag, parent
        self.own: frozenset[int] = frozenset() if hidden else _own_features(tag, attrs)
        self.above: tuple[_Open, ...] = parent.above if parent else ()  # hidden elements around, its own included
        self.ended = False
        self.found: tuple[frozenset[str], frozenset[int]] | None = None
        if hidden:
            self.above += (self,)

    def gathered(self) -> tuple[frozenset[str], frozenset[int]]:
        """Tags and features of this element and those around it, gathered where a block needs them."""
        path, at = [], self
        while at is not None and at.found is None:
            path.append(at)
            at = at.parent
        tags, features = at.found if at is not None else (frozenset(), frozenset())
        if path:
            self.found = (tags.union(o.tag for o in path if o.own), features.union(*[o.own for o in path]))
        return self.found


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in page order."""
    page = page or ""
    stack: list[_Open] = []
    counts: dict[str, int] = {}
    read: list[tuple[str | None, bool, _Open | None]] = []  # texts and, as None, the ends of blocks
    links = 0
    at, n = 0, len(page)

    def add(text: str | None, link: bool = False) -> None:
        if text is not None and stack and stack[-1].tag == "head" and not text.isspace():
            add(None)
            pop_to("head")
        read.append((text, link, stack[-1] if stack else None))

    def push(tag: str, attrs: str, hidden: bool = False) -> None:
        stack.append(_Open(tag, attrs, stack[-1] if stack else None, hidden))
        counts[tag] = counts.get(tag, 0) + 1

    def pop_to(tag: str, ended: bool = False) -> None:
        while stack:
            top = stack.pop()
            counts[top.tag] -= 1
            if top.tag == tag:
                top.ended = ended
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            add(_html.unescape(page[at:lt]), links > 0)
            if lt == n:
                break
        if page.startswith("<!--", lt):
            end = _COMMENT_END.search(page, lt + 2)
            at = n if not end else end.end()
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            add("<", links > 0)
            at = lt + 1
            continue
        at = m.end()
        if page[at - 1 : at] != ">":  # an unclosed quote or the end of the page
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if not closing and stack:
            if stack[-1].tag == "svg" and tag in BREAKOUT:
                pop_to("svg")
            if stack[-1:] and stack[-1].tag == "head" and tag not in IN_HEAD:
                add(None)
                pop_to("head")
        if not closing and tag in RAW:
            foreign = bool(stack) and stack[-1].tag == "svg"
            if foreign and attrs.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])" + ("|</svg" if foreign else ""), re.I).search(page, at)
            if foreign and (not end or end[0].lower() == "</svg"):
                continue
            at = n if not end else end.start()
            if end:
                gt = page.find(">", at)
                at = n if gt < 0 else gt + 1
            continue
        if tag in HIDDEN or tag in FOREIGN_HTML and stack and stack[-1].above:
            if closing:
                if counts.get(tag):
                    pop_to(tag, ended=True)
            elif not (tag == "svg" or tag in FOREIGN_HTML) or not attrs.endswith("/"):
                if tag in ALONE and counts.get(tag):
                    pop_to(tag)
                push(tag, attrs, hidden=True)
        elif tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK:
            add(None)
            links = 0
            if closing:
                if counts.get(tag):
                    pop_to(tag)
            else:
                if counts.get("p") and stack[-1].tag == "p":
                    pop_to("p")
                if tag in CLOSES:
                    sibling, bounds = CLOSES[tag]
                    if counts.get(sibling):
                        for above in reversed(stack):
                            if above.tag == sibling:
                                pop_to(sibling)
                                break
                            if above.tag in bounds or above.tag in HIDDEN:
                                break
                if tag not in VOID:
                    push(tag, attrs)
    add(None)
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    for piece, link, inside in read:
        if inside and any(h.ended for h in inside.above):
            continue
        if piece is not None:
            pieces.append((piece, link))
            continue
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            linked = len("".join(p for p, link in pieces if link).strip())
            out.append(_block(text, min(1.0, linked / len(text)), inside))
        pieces.clear()
    return out


def _block(text: str, linked: float, inside: _Open | None) -> Block:
    words = text.split()
    own = [f"own:{inside.tag if inside else ''}", f"links:{int(linked * 4)}", f"size:{min(7, len(words).bit_length())}"]
    if text[-1] in ".!?。":
        own.append("ends")
    if "©" in text:
        own.append("sign")
    if len(words) <= 16:
        own += [f"cue:{w}" for w in {t.lower() for t in _TOKEN.findall(text)} & CUES]
    tags, around = inside.gathered() if inside else (frozenset(), frozenset())
    features = set(around)
    features.update(_feature(x) for x in own)
    features.add(_feature("bias"))
    return Block(text, tuple(sorted(features)), tags)


@dataclass
class Model:
    weights: np.ndarray  # per feature: score of content less that of the rest
    turns: np.ndarray  # (2, 2) score of one label after another

    def emissions(self, page: list[Block]) -> np.ndarray:
        return np.array([self.weights[list(b.features)].sum() for b in page])

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the labels of highest joint score."""
        score0, score1, back = 0.0, 0.0, []
        (t00, t01), (t10, t11) = self.turns.tolist()
        for i, e in enumerate(self.emissions(page).tolist()):
            if i == 0:
                score1 = e
                continue
            from0, from1 = score1 + t10 > score0 + t00, score1 + t11 >= score0 + t01
            back.append((from0, from1))
            score0, score1 = max(score0 + t00, score1 + t10), max(score0 + t01, score1 + t11) + e
        label = score1 >= score0
        labels = [label]
        for from0, from1 in reversed(back):
            label = from1 if label else from0
            labels.append(label)
        return labels[::-1] if page else []

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, keep in zip(found, self.decode(found)) if keep)


# Names that pages give to their parts; the labelled layouts draw from them.
CONTENT_NAMES = ("content", "post", "entry", "article", "article-body", "story", "post-content", "entry-content", "main-content",
                 "text", "body-text", "page-content", "blog-post", "news-article", "prose", "container", "wrapper", "col-md-8")
PARTS = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "top-menu", "site-nav", "pagination", "pager", "toc-nav"),
    "header": ("header", "site-header", "masthead", "topbar", "branding", "page-header", "logo"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "page-footer"),
    "aside": ("sidebar", "side", "widget", "related", "related-posts", "recommended", "most-read", "trending", "tags", "author-box"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "ad-slot", "adsbox", "advertorial", "billboard"),
    "notice": ("notice", "cookie", "cookie-banner", "consent", "alert", "popup", "modal", "gdpr", "message", "warning", "paywall", "announcement", "disclaimer", "callout", "infobar", "overlay"),
    "form": ("form", "search", "login", "newsletter", "subscribe", "signup", "contact-form", "poll"),
    "comments": ("comments", "comment", "comment-list", "comments-area", "responses", "discussion", "replies", "reply", "respond", "disqus-thread", "reader-comments", "user-comments", "commentlist", "feedback", "reactions"),
    "share": ("share", "social", "social-links", "sharing", "toolbar", "follow"),
}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "alert", "form": "search"}
OWN_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}
CONTENT, REST = "\x01", "\x02"  # marks that carry a block's label through the parser


def dress(content: list[tuple[str, str]], prose: list[str], short: list[str], rng: random.Random) -> str:
    """A page around ``content`` (tag, text) with other parts; every block starts with its label's mark."""
    esc = _html.escape

    def rest(text: str) -> str:
        return REST + esc(text)

    def attrs(part: str) -> str:
        name = rng.choice(PARTS[part])
        kind = rng.random()
        if kind < 0.5:
            return f' class="{name}"'
        if kind < 0.75:
            return f' id="{name}"'
        return f' class="{name} {rng.choice(("clearfix", "box", "block", "section", "inner"))}"'

    def wrap(part: str, inner: str) -> str:
        tag = OWN_TAGS.get(part)
        pick = rng.random()
        if tag and part != "comments" and pick < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        if part in ROLES and pick < 0.5:
            return f'<div role="{ROLES[part]}">{inner}</div>'
        outer = tag if tag and pick < 0.7 else rng.choice(("div", "div", "section"))
        return f"<{outer}{attrs(part)}>{inner}</{outer}>"

    def part(kind: str) -> str:
        if kind in ("nav", "share"):
            items = "".join(f"<li><a href=/x>{rest(rng.choice(short))}</a></li>" for _ in range(rng.randint(2, 7)))
            return wrap(kind, f"<ul>{items}</ul>")
        if kind == "footer":
            return wrap(kind, rng.choice(("", "<p>")) + rest(rng.choice(("© ", "Copyright ", "")) + rng.choice(short + prose)))
        if kind == "comments":
            inner = "".join(
                rng.choice(("<div class=comment><p>{}</p></div>", "<li><p>{}</p></li>", "<article class=comment><p>{}</p></article>", "<p>{}</p>")).format(
                    rest(rng.choice(prose))) for _ in range(rng.randint(1, 4)))
            return wrap(kind, rng.choice((f"<h3>{rest('Comments')}</h3>", "")) + inner)
        if kind == "form":
            return wrap(kind, f"<label>{rest(rng.choice(short))}</label> <input name=q>" + rng.choice(("", f"<p>{rest(rng.choice(prose))}</p>")))
        if kind == "header":
            return wrap(kind, rng.choice(("<div>{}</div>", "<h1>{}</h1>", "<p>{}</p>", "<a href=/>{}</a>")).format(rest(rng.choice(short))))
        return wrap(kind, rng.choice(("{}", "<p>{}</p>", "<h3>{}</h3>")).format(rest(rng.choice(prose + short))))

    inner = []
    for tag, text in content:
        if rng.random() < 0.08:  # cues occur in articles, too
            text += " " + rng.choice(("© 2020", "©", *sorted(CUES)))
        shown = CONTENT + esc(text)
        inner.append({"li": f"<ul><li>{shown}</ul>", "td": f"<table><tr><td>{shown}</table>"}.get(tag, f"<{tag}>{shown}</{tag}>"))
        if rng.random() < 0.12:
            inner.append(part(rng.choice(("ad", "aside", "form", "notice", "share"))))
    tail = part("comments") if rng.random() < 0.5 else ""
    body = "".join(inner)
    pick, name = rng.random(), rng.choice(CONTENT_NAMES)
    inside = rng.random() < 0.4
    body += tail if inside else ""
    if pick < 0.25:
        body = f"<article>{body}</article>"
    elif pick < 0.4:
        body = f"<main>{body}</main>"
    elif pick < 0.55:
        body = f"<main><article class={name}>{body}</article></main>"
    elif pick < 0.65:
        body = f"<div>{body}</div>"
    elif pick < 0.9:
        body = f'<div {rng.choice(("class", "id"))}="{name}">{body}</div>'
    body += "" if inside else tail
    before = [part(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.6]
    after = [part(k) for k in ("share", "aside", "ad", "nav", "form", "notice", "footer") if rng.random() < 0.5]
    page = f"{''.join(before)}{body}{''.join(after)}"
    if rng.random() < 0.3:  # a frame around all of it says nothing
        page = rng.choice(("<div>{}</div>", "<div id=page>{}</div>", "<div class=wrapper><div>{}</div></div>")).format(page)
    return f"<html><body>{page}</body></html>"


_OUTSIDE = frozenset(("nav", "header", "footer", "aside", "form"))
# Names of parts that may stand inside an article without being its text.
_DOUBTFUL = frozenset(
    _feature(f"class:{name}") for kind in ("ad", "notice", "comments") for name in PARTS[kind] if "-" not in name)
SHORT = 6  # words of a text that may be a label or a link
STOCK = ("Nothing else here, only one sentence.", "It had been raining for two days when the boat came in.",
         "The council will vote on the plan next week, and nobody knows how it will end.")


def labelled_pages(pages: list[str], seed: int = SEED, layouts: int = LAYOUTS) -> list[tuple[list[Block], np.ndarray]]:
    """Training sequences: the sampled pages as they are, where semantics settle them, and dressed anew.

    Blocks under a name of adverts, notices or comments are neither: they may stand inside an
    article, and nothing but the name tells. A page without settled content lends its longer
    texts to the layouts; so every sample, an empty one too, has both labels.
    """
    rng = random.Random(seed)
    found = [blocks(p) for p in pages]
    out, contents, prose, short = [], [], [], []
    for page in found:
        settled = [b for b in page if not _DOUBTFUL & set(b.features)]
        labels = np.array([bool(b.tags & {"article", "main"}) and not b.tags & _OUTSIDE for b in settled], int)
        inside = [b for b, y in zip(settled, labels) if y]
        if inside:
            out.append((settled, labels))
        else:
            inside = [b for b in settled if len(b.text.split()) > SHORT]
        if inside:
            contents.append([b.text for b in inside])
        for b in page:
            (short if len(b.text.split()) <= SHORT else prose).append(b.text)
    contents = contents or [list(STOCK)]
    prose = prose or list(STOCK[:1])
    short = short or ["Home"]
    for texts in contents:
        for _ in range(layouts):
            shown = []
            for i, text in enumerate(texts):
                tag = rng.choice(("h1", "h2")) if i == 0 else rng.choices(
                    ("p", "h2", "h3", "li", "blockquote", "td", "pre", "figcaption", "div"), (20, 1, 1, 2, 1, 1, 1, 1, 2))[0]
                shown.append((tag, text if rng.random() < 0.8 else rng.choice(short)))
            page = blocks(dress(shown, prose, short, rng))
            labels = np.array([b.text.startswith(CONTENT) for b in page], int)
            clean = [_plain(b) for b in page]
            out.append((clean, labels))
    return out


def _plain(b: Block) -> Block:
    return Block(b.text.replace(CONTENT, "").replace(REST, ""), b.features, b.tags)


def marginals(emissions: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of content per block, and of both labels of each neighbouring pair (forward-backward in logs)."""
    n = len(emissions)
    e = np.column_stack([np.zeros(n), emissions])
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = e[0]
    for i in range(1, n):
        a[i] = np.logaddexp(a[i - 1, 0] + turns[0], a[i - 1, 1] + turns[1]) + e[i]
    for i in range(n - 2, -1, -1):
        step = e[i + 1] + b[i + 1]
        b[i] = np.logaddexp(turns[:, 0] + step[0], turns[:, 1] + step[1])
    z = np.logaddexp(*a[-1])
    return np.exp(a[:, 1] + b[:, 1] - z), np.exp(a[:-1, :, None] + turns[None] + (e[1:] + b[1:])[:, None, :] - z)


def train(sequences: list[tuple[list[Block], np.ndarray]], seed: int = SEED) -> Model:
    """Conditional log-likelihood by stochastic gradient (AdaGrad), forward-backward in logs."""
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    g_w, g_t = np.full(FEATURES, 1e-2), np.full((2, 2), 1e-2)
    data = [([np.array(b.features) for b in page], y) for page, y in sequences if len(page)]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            features, y = data[k]
            p1, pairs = marginals(np.array([model.weights[f].sum() for f in features]), model.turns)
            if len(y) > 1:
                pairs = pairs.sum(0)
                np.add.at(pairs, (y[:-1], y[1:]), -1)
                g_t += pairs**2
                model.turns = model.turns - 0.2 * pairs / np.sqrt(g_t)
            where = np.concatenate(features)
            grad = np.repeat(p1 - y, [len(f) for f in features])
            touched, inverse = np.unique(where, return_inverse=True)
            g = np.bincount(inverse, grad) + PENALTY * model.weights[touched]
            g_w[touched] += g * g
            model.weights[touched] -= 0.2 * g / np.sqrt(g_w[touched])
    return model


def fit(pages: DataFrame, n: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """Train on at most ``n`` pages drawn by hash, so a table of any size is sampled all over."""
    drawn = (
        pages.select("html").filter((F.length("html") <= TRAIN_CHARS) & (F.length("html") > 0))
        .orderBy(F.xxhash64(F.lit(seed), "html"), "html").limit(n).collect()
    )
    return train(labelled_pages([r["html"] for r in drawn], seed), seed)


def extractor(model: Model):
    """A column function: html -> main text."""

    @F.pandas_udf(T.StringType())
    def extract(page: pd.Series) -> pd.Series:
        return pd.Series([model.extract(p) for p in page], dtype=object)

    return extract
