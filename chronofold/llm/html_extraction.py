"""HTML extraction: a recurrent labeller decides for each block of a page whether it belongs to the main text.

A page becomes the sequence of its leaf blocks (runs of text between block-level tags), each with its path of tags, classes
and ids. A block's vector hashes the path and the words, and has a few measures (length, share of link text, place on the
page). A bidirectional LSTM in numpy reads the whole sequence, so that every block is judged with the context of
the entire page, and a logistic unit labels it. Blocks labelled as main text are joined in page order.

There are no labels of blocks, so the labeller learns from pages it makes itself: the text of at most SAMPLE pages of the
corpus (each of at most SAMPLE_BYTES), whose semantic tags tell articles from other parts, is set into page layouts of
many kinds, with articles in containers of many names, and with menus, notices, adverts, forms, side columns, footers
and reader comments around and inside them. Sampling bounds the training only; every page is extracted as a whole.

A block refers to its place in the tree of open elements, which holds its path as a mask of hashed bits; so neither time nor memory grows with
the depth of a page. Vectors of blocks exist some thousand at a time; of a page's sequence only what its two recurrences take in is kept whole.

Scripts, styles, comments in the markup, titles and the like never become blocks; templates, drawings, objects and the like do so
only where they have no end tag. Formulas are text. Character references are decoded, white
space within a block becomes one space.

Defined results: null or empty html, and html without main text, give an empty string; repeated rows are extracted each;
html without tags is one block; unclosed tags, quotes and comments end with the page; very long and very deep pages are extracted whole; an
empty table gives an empty result; columns other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import Bounded, arrow, bounded_sample, rows_in

#: Pages whose text goes into the training pages, at most, and their size.
SAMPLE, SAMPLE_BYTES = 160, 60_000
PATH_DIMS, WORD_DIMS, MEASURES = 192, 16, 8
#: Bits of a path that stand for its innermost tag; blocks whose vectors are held at once.
INNER, CHUNK = 32, 4096
WIDTH = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 12

# HTML elements by kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
BOUNDS = frozenset("ul ol dl table div article section main body".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<whole>template|noscript|iframe|svg|object|select)(?=[\s/>])(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in "template noscript iframe svg object select".split()}
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[a-z]+")


class Place:
    """An open block-level element: its tag and names, its depth, and the bits of all words of its path. The page itself has no tag."""

    __slots__ = ("up", "tag", "names", "depth", "mask")

    def __init__(self, up: Place | None, tag: str, names: str):
        self.up, self.tag, self.names = up, tag, names
        self.depth = up.depth + 1 if up else 0
        self.mask = up.mask if up else 0
        if up:
            for word in [f"<{tag}", *_PARTS.findall(names)]:
                self.mask |= 1 << zlib.crc32(word.encode()) % (PATH_DIMS - INNER)

    def path(self) -> list[tuple[str, str]]:
        """Tags and names from the outermost element in."""
        out, at = [], self
        while at.up:
            out.append((at.tag, at.names))
            at = at.up
        return out[::-1]


@dataclass(slots=True)
class Block:
    place: Place
    text: str
    link_chars: int


class _Open:
    """The stack of open elements. Counts by tag tell at once whether a search down the stack can find anything."""

    def __init__(self):
        self.stack: list[tuple[str, Place]] = []
        self.count: Counter[str] = Counter()
        self.page = Place(None, "", "")

    @property
    def place(self) -> Place:
        return self.stack[-1][1] if self.stack else self.page

    def push(self, tag: str, names: str) -> None:
        self.stack.append((tag, self.place if tag in INLINE else Place(self.place, tag, names)))
        self.count[tag] += 1

    def close(self, upto: int) -> None:
        for tag, _ in self.stack[upto:]:
            self.count[tag] -= 1
        del self.stack[upto:]

    def end(self, tags: set[str], bounds: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of these tags and what is open in it, unless an element of bounds lies between."""
        if any(self.count[t] for t in tags):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in tags:
                    return self.close(k)
                if self.stack[k][0] in bounds:
                    return None
        return None


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    opened = _Open()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            got = "".join(text)
            got = " ".join((entities.unescape(got) if "&" in got else got).split())
            if got:
                out.append(Block(opened.place, got, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if opened.count["a"]:
            linked += len(piece.strip())

    if not page:
        return out
    at = 0
    open_ended: set[str] = set()
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() == "textarea":
                flush()
            continue
        if m["whole"]:
            name = m["whole"].lower()
            if name == "svg" and m[0].endswith("/>"):
                continue
            # without an end tag nothing is left out, and later elements of the name have none either
            end = None if name in open_ended else _ENDS[name].search(page, at)
            if end:
                at = end.end()
            else:
                open_ended.add(name)
            if name == "select" or not end:
                flush()
            continue
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if m["end"]:
            opened.end({tag})
            continue
        if tag not in INLINE:
            opened.end(CLOSES.get(tag, {"p"}), BOUNDS)
        attrs = m["attrs"]
        names = " ".join(x.strip("\"'") for x in _NAMES.findall(attrs)).lower() if "=" in attrs else ""
        if not attrs.endswith("/"):
            opened.push(tag, names)
    if at < len(page):
        add(page[at:])
    flush()
    return out


def path_vector(key: tuple[int, str]) -> np.ndarray:
    """Mask of a path as zeros and ones, with the innermost tag marked apart."""
    mask, tag = key
    out = np.zeros(PATH_DIMS, np.float32)
    out[: PATH_DIMS - INNER] = np.unpackbits(np.frombuffer(mask.to_bytes((PATH_DIMS - INNER) // 8, "little"), np.uint8), bitorder="little")
    if tag:
        out[PATH_DIMS - INNER + zlib.crc32(tag.encode()) % INNER] = 1
    return out


class Features:
    """Block sequences to matrices."""

    def __init__(self):
        self.path = Bounded(path_vector, 20_000)
        self.word = Bounded(lambda w: zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % (2 * WORD_DIMS), 300_000, longest=64)

    def __call__(self, seq: list[Block], start: int = 0, total: int | None = None) -> np.ndarray:
        """Vectors of blocks that begin at place start of a page of total blocks."""
        total = len(seq) if total is None else total
        out = np.zeros((len(seq), WIDTH), np.float32)
        words = [b.text.split() for b in seq]
        n = np.array([len(w) for w in words])
        bucket = np.fromiter(map(self.word.__getitem__, (w for ws in words for w in ws)), np.int64, n.sum())
        both = np.bincount(np.repeat(np.arange(len(seq)), n) * 2 * WORD_DIMS + bucket, minlength=len(seq) * 2 * WORD_DIMS).reshape(len(seq), 2, WORD_DIMS)
        out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = (both[:, 0] - both[:, 1]) / n[:, None]
        for k, b in enumerate(seq):
            out[k, :PATH_DIMS] = self.path[b.place.mask, b.place.tag]
            out[k, -MEASURES:] = (
                min(8, np.log1p(n[k])) / 4, min(1, b.link_chars / len(b.text)), b.text[-1] in ".!?…", "©" in b.text, (start + k) / total, min(b.place.depth, 50) / 10, b.text[0].isupper(), 1,
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM. Weights of the forward (0) and backward (1) direction, then of the output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "01":
            self.p |= {f"W{d}": rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN)), f"U{d}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.zeros(4 * HIDDEN)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"o": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, pre: np.ndarray, live: np.ndarray, d: str, keep: bool):
        """Hidden states over time (T, B, H) and, if asked, what the gradient needs; states stand still where live is 0."""
        steps, n, _ = pre.shape
        h, c, u = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), self.p[f"U{d}"]
        hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
            g = pre[t] + h @ u
            s = _sigmoid(g[:, : 3 * HIDDEN])
            z = np.tanh(g[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            on = live[t][:, None]
            c_new = f * c + i * z
            tc = np.tanh(c_new)
            if keep:
                kept.append((t, h, c, i, f, o, z, tc, on))
            h, c = np.where(on, o * tc, h), np.where(on, c_new, c)
            hs[t] = h
        return hs, kept

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What both recurrences take in of each vector: forward gates, then backward gates."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "01"], axis=-1)

    def forward(self, pre: np.ndarray, live: np.ndarray, keep: bool = False):
        (a, ka), (b, kb) = (self._direction(pre[:, :, 4 * HIDDEN * k : 4 * HIDDEN * (k + 1)], live, d, keep) for k, d in enumerate("01"))
        h = np.concatenate([a, b], axis=2)
        return _sigmoid(h @ self.p["o"] + self.p["c"]), h, (ka, kb)

    def gradient(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out, h, kept = self.forward(self.inputs(x), live, keep=True)
        g = (out - y) * live / live.sum()
        grads = {"o": np.tensordot(g, h, axes=([0, 1], [0, 1])), "c": g.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("01"):
            dhs = g[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            u = self.p[f"U{d}"]
            dh, dc = np.zeros(dhs.shape[1:], np.float32), np.zeros(dhs.shape[1:], np.float32)
            dw, du, db = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(u), np.zeros_like(self.p[f"b{d}"])
            for t, h0, c0, i, f, o, z, tc, on in reversed(kept[k]):
                dh = dh + dhs[t]
                dhn, dcn = np.where(on, dh, 0), np.where(on, dc, 0)
                dct = dcn + dhn * o * (1 - tc * tc)
                dg = np.concatenate([dct * z * i * (1 - i), dct * c0 * f * (1 - f), dhn * tc * o * (1 - o), dct * i * (1 - z * z)], axis=1)
                dw += x[t].T @ dg
                du += h0.T @ dg
                db += dg.sum(0)
                dh, dc = np.where(on, 0, dh) + dg @ u.T, np.where(on, 0, dc) + dct * f
            grads |= {f"W{d}": dw, f"U{d}": du, f"b{d}": db}
        return grads

    def fit(self, seqs: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, rate: float = 0.01, batch: int = 32) -> Labeller:
        rng, step = np.random.default_rng(5), 0
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for _ in range(epochs):
            by_length = sorted(range(len(seqs)), key=lambda i: (len(seqs[i]), i))
            groups = [by_length[k : k + batch] for k in range(0, len(by_length), batch)]
            for k in rng.permutation(len(groups)):
                x, live = pad([seqs[i] for i in groups[k]])
                y = pad([labels[i][:, None] for i in groups[k]])[0][:, :, 0]
                step += 1
                for n, g in self.gradient(x, live, y).items():
                    m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                    self.p[n] = (self.p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of sequences of inputs(); those of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
        while order:
            most = max(1, 4096 // max(1, len(seqs[order[0]])))
            now, order = order[:most], order[most:]
            while len(now) > 1 and len(seqs[now[-1]]) > 2 * len(seqs[now[0]]) + 8:
                order.insert(0, now.pop())
            x, live = pad([seqs[i] for i in now])
            got = self.forward(x, live)[0]  # no tape: states of two steps and the hidden rows
            for k, i in enumerate(now):
                out[i] = got[: len(seqs[i]), k]
        return out


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, seqs))
    x, live = np.zeros((steps, len(seqs), seqs[0].shape[1]), np.float32), np.zeros((steps, len(seqs)), bool)
    for k, s in enumerate(seqs):
        x[: len(s), k], live[: len(s), k] = s, True
    return x, live


# Names that page layouts give to their parts.
MAIN_NAMES = ["content", "post", "entry-content", "article-body", "main-content", "story", "post-body", "text", "body-text", "page-content", "articleBody", "blog-post", "wrapper", "container", ""]
OTHER_NAMES = {
    "menu": ["nav", "navbar", "menu", "main-menu", "topnav", "navigation", "breadcrumb", "breadcrumbs", "site-nav", "links", "toc", "pagination", "pager", "tabs"],
    "head": ["header", "site-header", "masthead", "top", "topbar", "banner", "logo", "branding"],
    "foot": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "foot"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "more-stories", "tags", "author-box", "meta", "byline"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "alert", "notice", "message", "popup", "modal", "overlay", "banner-notice"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsense", "sponsor", "banner-ad", "ad-slot"],
    "form": ["form", "search", "newsletter", "subscribe", "login", "signup", "contact-form"],
    "share": ["share", "social", "sharing", "follow", "social-links"],
    "comments": ["comments", "comment", "comment-list", "disqus", "responses", "replies", "comment-body", "discussion", "reader-comments", "user-comments"],
}
OTHER_TAGS = {"menu": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section"], "ad": ["div", "aside"], "form": ["form", "div"], "share": ["div", "ul"], "comments": ["section", "div", "ol"]}
SAYINGS = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. Accept", "Please enable JavaScript.", "Accept all", "You have 3 free articles left."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 50%", "Limited offer, order today!"],
    "form": ["Search", "Sign up for our newsletter", "Email address", "Subscribe", "Log in", "Password", "Send"],
    "share": ["Share this", "Tweet", "Share on Facebook", "Follow us", "Email"],
    "foot": ["© 2024 Example Ltd. All rights reserved.", "Privacy policy", "Terms of use", "Contact us", "Imprint"],
    "head": ["Example News", "Welcome", "Home"],
    "side": ["Related articles", "Most read", "Read more", "About the author", "Tags"],
    "comments": ["3 comments", "Reply", "Great article, thanks!", "Leave a comment", "I do not agree with this.", "posted 2 hours ago"],
    "menu": ["Home", "About", "Contact", "News", "Next", "Previous"],
}
SEMANTIC_OTHER = frozenset("nav footer header aside form".split())


def silver(seq: list[Block]) -> list[bool] | None:
    """Labels of a real page that semantic tags give away; None where it has no article."""
    paths = [b.place.path() for b in seq]
    marks = [[t for t, _ in p] for p in paths]
    names = {w for ws in OTHER_NAMES.values() for w in ws}
    if not any("article" in m or "main" in m for m in marks):
        return None
    return [("article" in m or "main" in m) and not SEMANTIC_OTHER & set(m) and not any(w in names for _, n in p for w in n.split()) for m, p in zip(marks, paths, strict=True)]


def make_page(rng: random.Random, mains: list[str], others: list[str]) -> tuple[str, list[bool]]:
    """A page in a layout of its own from real text, and the labels of its blocks."""
    out: list[tuple[str, bool | None]] = []
    esc = entities.escape
    some = lambda n: " ".join(rng.choice(others).split()[: rng.randint(1, n)]) or "x"

    def other(kind: str) -> None:
        tag = rng.choice(OTHER_TAGS[kind])
        name = rng.choice(OTHER_NAMES[kind])
        named = tag == "div" or tag in ("ul", "ol", "section") or rng.random() < 0.4
        out.append((f'<{tag} {rng.choice(["class", "id"])}="{name}">' if named else f"<{tag}>", None))
        lists = tag in ("ul", "ol") or kind in ("menu", "share") and rng.random() < 0.7
        if lists and tag not in ("ul", "ol"):
            out.append(("<ul>", None))
        for _ in range(rng.randint(1, 7 if lists or kind == "comments" else 3)):
            text = esc(rng.choice(SAYINGS[kind]) if rng.random() < 0.4 else rng.choice(mains) if kind in ("comments", "side", "ad") and rng.random() < 0.5 else some(25 if kind in ("ad", "comments", "side") else 5))
            if lists:
                out.append((f'<li><a href="/x">{text}</a></li>' if kind != "comments" else f"<li><p>{text}</p></li>", False))
            elif kind == "ad" or rng.random() < 0.3:
                out.append((f"{text}<br>" if kind == "ad" else f"<div>{text}</div>", False))
                if kind == "ad":
                    break
            else:
                out.append((f"<p>{text}</p>" if rng.random() < 0.7 else f"<h3>{text}</h3>", False))
        if lists and tag not in ("ul", "ol"):
            out.append(("</ul>", None))
        out.append((f"</{tag}>", None))

    for kind in rng.sample(["head", "menu", "notice", "ad", "form", "share", "menu", "side"], rng.randint(0, 5)):
        other(kind)
    container = rng.choice(["article", "article", "article", "main", "div", "div", "div", "section", "td"])
    name = rng.choice(MAIN_NAMES)
    wraps = [w for w in ('<div id="page">', '<div class="container">', "<main>") if rng.random() < 0.3]
    out.extend((w, None) for w in wraps)
    if container == "td":
        out.append(("<table><tr>", None))
    out.append((f'<{container} class="{name}">' if name and (container in ("div", "section", "td") or rng.random() < 0.3) else f"<{container}>", None))
    if rng.random() < 0.8:
        out.append((f"<h1>{esc(rng.choice(mains)[:90]) or 'x'}</h1>", True))
    for k in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
        text, r = esc(rng.choice(mains)), rng.random()
        if r < 0.08:
            out.append((f"<h2>{esc(rng.choice(mains)[:60])}</h2>", True))
        elif r < 0.13:
            out.append(("<ul>", None))
            out.extend((f"<li>{esc(rng.choice(mains)[:120])}</li>", True) for _ in range(rng.randint(1, 5)))
            out.append(("</ul>", None))
        elif r < 0.17:
            out.append((f"<blockquote><p>{text}</p></blockquote>", True))
        elif r < 0.2:
            out.append((f"<pre>{text}</pre>", True))
        elif r < 0.24:
            out.append((f"<div>{text}</div>", True))
        elif r < 0.28:
            out.append((f'<p><a href="/y">{text}</a></p>', True))
        else:
            out.append((f"<p>{text}</p>", True))
        if k and rng.random() < 0.06:
            other(rng.choice(["ad", "side", "share", "form"]))
    if rng.random() < 0.25:
        other(rng.choice(["comments", "share", "side"]))
    out.append((f"</{container}>" + ("</tr></table>" if container == "td" else ""), None))
    out.extend((f"</{w[1:].split()[0].rstrip('>')}>", None) for w in reversed(wraps))
    for kind in rng.sample(["comments", "comments", "foot", "side", "ad", "form", "notice", "menu", "share"], rng.randint(1, 4)):
        other(kind)
    if rng.random() < 0.6:
        other("foot")
    page = "<html><body>" + "".join(x for x, _ in out) + "</body></html>"
    return page, [y for x, y in out if y is not None and blocks(x)]


#: Texts for layouts where the corpus has none with semantic tags.
PLAIN = ["The committee met on Tuesday to discuss the plan and agreed on most of its parts.", "Rain is expected in the north, with some sun later in the week.", "A short note on the history of the town follows.", "Readers will remember the story from last year, when the bridge was closed for repairs and traffic went around it for months."]


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Fit on layouts made of the text of a bounded sample of pages, and on the sample's own layouts."""
    small = pages.select("page_id", "html").filter(F.octet_length("html").between(1, SAMPLE_BYTES))
    rows = bounded_sample(small, sample, "page_id", "html").collect()
    features, seqs, labels, mains, others = Features(), [], [], [], []
    for r in rows:
        seq = blocks(r.html)
        if seq and (marks := silver(seq)):
            seqs.append(features(seq))
            labels.append(np.array(marks, np.float32))
            mains += [b.text for b, y in zip(seq, marks, strict=True) if y]
            others += [b.text for b, y in zip(seq, marks, strict=True) if not y]
    rng = random.Random(3)
    for _ in range(1600):
        page, marks = make_page(rng, mains or PLAIN, others or PLAIN)
        seq = blocks(page)
        if len(seq) == len(marks):
            seqs.append(features(seq))
            labels.append(np.array(marks, np.float32))
    return Labeller().fit(seqs, labels)


def inputs_of(seq: list[Block], features: Features, labeller: Labeller) -> np.ndarray:
    """The labeller's inputs for a page, made CHUNK blocks at a time."""
    parts = [labeller.inputs(features(seq[k : k + CHUNK], k, len(seq))) for k in range(0, len(seq), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, 8 * HIDDEN), np.float32)


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches):
        features = Features()
        for ids, urls, pages in rows_in(batches, "page_id", "url", "html", size=100):
            seqs = [blocks(p) for p in pages]
            chosen = labeller.label([inputs_of(s, features, labeller) for s in seqs])
            texts = ["\n".join(b.text for b, y in zip(s, ys, strict=True) if y >= 0.5) for s, ys in zip(seqs, chosen, strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
