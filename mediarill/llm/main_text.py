"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import _slices
from .remembered import Remembered

# Fixed values of HTML: elements inside a line of text, without content, and whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img picture source".split())
# Drawings, formulas and players stand inside a line too, and what they hold beside them, with their own elements.
INLINE |= frozenset("svg g path circle rect line polyline polygon ellipse tspan use defs math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup mover munder munderover mtable mtr mtd mstyle mpadded mfenced menclose annotation object canvas audio video track iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
CLOSED_BY_BLOCK = frozenset(["p"])
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Fixed values of the weak labels and page variants used in training: element names and words of class or id.
MAIN_NAMES = ["article", "main", "content", "post", "entry", "story", "body-text", "article-body", "post-content", "entry-content", "text", "page-content"]
OTHER_NAMES = [
    "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sidebar", "side", "widget", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "toc", "comment", "comments", "comment-list", "discussion", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "related",
    "recommended", "share", "social", "tags", "pagination", "copyright", "legal", "topbar", "masthead", "toolbar", "author", "bio",
]
_MAIN, _OTHER = frozenset(MAIN_NAMES), frozenset(OTHER_NAMES)
# Elements that hold other blocks rather than one text.
BOXES = frozenset("html body div section article main aside nav header footer form table tbody tr td th ul ol dl figure details dialog center fieldset".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAMES = re.compile(r"[a-z]+(?:-[a-z]+)*")

PATH, WORDS, COUNTS = 256, 64, 16
WIDTH = PATH + WORDS + COUNTS


class _Node:
    """An element on the way to a block: its names and what it encloses. Nodes know their parent, so a block needs only one."""

    __slots__ = ("tag", "names", "up", "root", "box", "depth", "chars", "linked", "blocks", "total", "weak", "fresh", "vector", "kids", "named")

    def __init__(self, tag: str, names: tuple[str, ...], up: _Node | None):
        self.tag, self.names, self.up = tag, names, up
        self.depth = up.depth + 1 if up else 0
        self.root = up.root if up else self
        self.box = self if up is None or tag in BOXES else up.box
        self.chars = self.linked = self.blocks = self.total = 0
        self.fresh, self.vector, self.kids, self.named = (), None, None, None
        # The weak label: 1 below something named as main, 0 below something named as not, the inner name deciding; None if nothing is named.
        self.weak = 0 if any(n in _OTHER for n in names) else 1 if any(n in _MAIN for n in names) else up.weak if up else None


class Block:
    """A leaf of the page: its text, the element it stands in, how much of it is link, and its tag path as hashed features."""

    __slots__ = ("text", "node", "linked", "path")

    def __init__(self, text: str, node: _Node, linked: float, path: np.ndarray):
        self.text, self.node, self.linked, self.path = text, node, linked, path

    @property
    def tag(self) -> str:
        return self.node.tag

    @property
    def names(self) -> tuple[str, ...]:
        """Names of the innermost element."""
        return self.node.names


class _Path:
    """The elements that are open, and hashed vectors of their names, each name counted once.

    A vector is made when a block asks for it, from the nearest one above;
    like elements of one parent share it.
    """

    def __init__(self):
        root = _Node("", (), None)
        root.vector = np.zeros(PATH, np.int16)
        self.stack = [root]
        self.times: dict[str, int] = {}

    def open(self, tag: str, names: tuple[str, ...]) -> None:
        node = _Node(tag, names, self.stack[-1])
        times = self.times
        node.fresh = tuple([n for n in names if not times.get(n)])
        for n in names:
            times[n] = times.get(n, 0) + 1
        self.stack.append(node)

    def close(self) -> None:
        for n in self.stack.pop().names:
            self.times[n] -= 1

    def vector(self) -> np.ndarray:
        at = len(self.stack) - 1
        while self.stack[at].vector is None:
            at -= 1
        for node in self.stack[at + 1 :]:
            up = node.up
            found = up.kids.get(node.names) if up.kids else None
            if found is None:
                found = up.vector.copy() if node.fresh else up.vector
                for name in node.fresh:
                    for place, sign in _slot(name):
                        found[place] += sign
                up.kids = up.kids if up.kids is not None else {}
                if len(up.kids) < 1000:
                    up.kids[node.names] = found
            node.vector = found
        return self.stack[-1].vector


def blocks_of(page: str) -> list[Block]:
    """The leaf sequence of a page: runs of text between block elements, in page order.

    Comments, declarations, scripts, styles and the like are passed over; unclosed
    and stray tags are put up with; character references are decoded, but not
    in CDATA sections; white space is made single. Runs without text are left
    out. Time and memory grow with the page's length, however deep it is.
    """
    path = _Path()
    open_tags: dict[str, int] = {}
    endless: set[str] = set()
    out: list[Block] = []
    run: list[str] = []
    linked, anchors = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            node = path.stack[-1]
            out.append(Block(text, node, min(1.0, linked / len(text)), path.vector()))
            box, node.root.total = node.box, node.root.total + len(text)
            box.chars, box.linked, box.blocks = box.chars + len(text), box.linked + min(linked, len(text)), box.blocks + 1
        run.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        run.append(text)
        if anchors:
            linked += len(text.strip())

    def close() -> None:
        open_tags[path.stack[-1].tag] -= 1
        path.close()

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            add(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            add(m[1])
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attrs = m[2] or m[5], m[4] or m[7] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/") and tag not in endless:
                end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            run.append(" ")
        elif tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors - 1) if closing else anchors + 1
        else:
            flush()
            anchors = 0
            if closing:
                if open_tags.get(tag):
                    while path.stack[-1].tag != tag:
                        close()
                    close()
            elif tag not in VOID:
                while path.stack[-1].tag in CLOSED_BY_BLOCK:
                    close()
                if tag in ALIKE and path.stack[-1].tag in ALIKE[tag]:
                    close()
                words = [w for a in _ATTR.finditer(attrs) for w in _NAMES.findall((a[2] or a[3] or a[4] or "").lower())]
                parts = [p for w in words if "-" in w for p in w.split("-")]
                path.open(tag, tuple(dict.fromkeys((tag, *words, *parts))))
                open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        add(entities.unescape(page[at:]))
    flush()
    return out


_slots: dict[str, list[tuple[int, int]]] = {}
_places: dict[tuple[str, ...], np.ndarray] = {}


class _WordPlaces(Remembered):
    """Word to its place in the word vector."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        self.add(word, h)
        return h


_words = _WordPlaces(8 << 20)


def _slot(name: str) -> list[tuple[int, int]]:
    """Three places and signs of a name in the path vector."""
    found = _slots.get(name)
    if found is None:
        h = [zlib.crc32(f"{k}{name}".encode("utf-8", "surrogatepass")) for k in range(3)]
        found = [(x % PATH, 1 if x >> 31 else -1) for x in h]
        if len(_slots) < 100_000:
            _slots[name] = found
    return found


def _named(node: _Node) -> _Node:
    """The innermost element around that has a class or id, or is more than a plain box; the root if there is none. Each node looks it up once."""
    asked = []
    while node.named is None:
        asked.append(node)
        if node.up is None or len(node.names) > 1 or node.tag in _MAIN or node.tag in _OTHER:
            node.named = node
        else:
            node = node.up
    for other in asked:
        other.named = node.named
    return node.named


def _place(node: _Node) -> np.ndarray:
    """The hashed vector of an element's own tag, its parent's, and the names of the innermost named element around it."""
    names = ("@" + node.tag, "^" + (node.up.tag if node.up else ""), *["%" + m for m in _named(node).names])
    found = _places.get(names)
    if found is None:
        wide = np.zeros(PATH, np.int64)
        for name in names:
            for place, sign in _slot(name):
                wide[place] += sign
        found = np.clip(wide, -99, 99).astype(np.int8)
        if len(_places) < 20_000:
            _places[names] = found
    return found


def vectors_of(blocks: list[Block], a: int = 0, b: int | None = None) -> np.ndarray:
    """Tag-path, hashed-word and count vectors of the blocks ``a`` up to ``b`` of a leaf sequence, one row a block."""
    n = max(1, len(blocks))
    own = blocks[a:b]
    x = np.zeros((len(own), WIDTH), np.float32)
    if not own:
        return x
    x[:, :PATH] = np.clip(np.array([t.path for t in own]), -9, 9)
    x[:, :PATH] += np.array([_place(t.node) for t in own])
    _words.make_room()
    flat: list[int] = []
    many = np.zeros(len(own), np.int64)
    rows = []
    for i, t in enumerate(own):
        words, node, box, text = t.text.split(), t.node, t.node.box, t.text
        many[i] = len(words)
        flat.extend(map(_words.__getitem__, words))
        stops = text.count(".") + text.count("!") + text.count("?") + text.count(",") + text.count(";")
        rows.append((
            len(words), len(text), t.linked, stops / max(1, len(words)), (a + i) / n, 1 - (a + i) / n, min(30, node.depth) / 10, text[-1] in ".!?:",
            box.chars, box.linked / max(1, box.chars), box.blocks, box.chars / node.root.total, any(map(str.isdigit, text[:40])), len(words) <= 4, node.weak == 1, node.weak == 0,
        ))
    at = np.repeat(np.arange(len(own)) * WORDS, many) + np.array(flat, np.int64)
    x[:, PATH : PATH + WORDS] = 2 * np.bincount(at, minlength=len(own) * WORDS).reshape(len(own), WORDS) / np.maximum(1, many)[:, None]
    counts = np.array(rows, np.float32)
    for column, scale in ((0, 4), (1, 6), (8, 8), (10, 4)):
        counts[:, column] = np.log1p(counts[:, column]) / scale
    x[:, PATH + WORDS :] = counts
    return x


class BiLstm:
    """A bidirectional LSTM over a leaf sequence with one logistic output a block, in numpy."""

    def __init__(self, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (rng.normal(0, 0.2, (WIDTH, 4 * h))).astype(np.float32)
            self.p[f"U{d}"] = (rng.normal(0, h**-0.5, (h, 4 * h))).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1.0
            self.p[f"c{d}"] = bias
        self.p["V"] = rng.normal(0, 0.3, (2 * h,)).astype(np.float32)
        self.p["S"] = np.zeros(WIDTH, np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    @staticmethod
    def _sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _run(self, x: np.ndarray, on: np.ndarray, d: str, keep: bool):
        """States along axis 0 for one direction; blocks that are off leave the state as it is."""
        return self._run_on(x @ self.p[f"W{d}"] + self.p[f"c{d}"], on, d, keep)

    def _run_on(self, z: np.ndarray, on: np.ndarray, d: str, keep: bool):
        steps, batch, h = z.shape[0], z.shape[1], self.hidden
        hs = np.zeros((steps, batch, h), np.float32)
        s, c = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + s @ self.p[f"U{d}"]
            i, f, o = self._sig(g[:, :h]), self._sig(g[:, h : 2 * h]), self._sig(g[:, 2 * h : 3 * h])
            a = np.tanh(g[:, 3 * h :])
            c2 = f * c + i * a
            tc = np.tanh(c2)
            s2 = o * tc
            m = on[t][:, None]
            if keep:
                kept.append((t, s, c, i, f, o, a, tc, m))
            s, c = np.where(m, s2, s), np.where(m, c2, c)
            hs[t] = s
        return hs, kept

    def forward(self, x: np.ndarray, on: np.ndarray, keep: bool = False):
        hf, kf = self._run(x, on, "f", keep)
        hb, kb = self._run(x, on, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return self._sig(both @ self.p["V"] + x @ self.p["S"] + self.p["o"]), (both, kf, kb)

    def gradients(self, x: np.ndarray, on: np.ndarray, y: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        q, (both, kf, kb) = self.forward(x, on, True)
        h = self.hidden
        e = ((q - y) * known / max(1.0, known.sum())).astype(np.float32)
        g = {"V": np.einsum("tb,tbh->h", e, both), "S": np.einsum("tb,tbd->d", e, x), "o": np.array([e.sum()], np.float32)}
        back = e[:, :, None] * self.p["V"]
        for d, kept, part in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            dz = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
            gu = np.zeros_like(self.p[f"U{d}"])
            ds, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, s, c, i, f, o, a, tc, m in reversed(kept):
                ds = ds + part[t]
                s2, c2 = ds * m, dc * m + ds * m * o * (1 - tc * tc)
                zi = np.concatenate([c2 * a * i * (1 - i), c2 * c * f * (1 - f), s2 * tc * o * (1 - o), c2 * i * (1 - a * a)], 1)
                dz[t] = zi
                gu += s.T @ zi
                ds = np.where(m, zi @ self.p[f"U{d}"].T, ds)
                dc = np.where(m, c2 * f, dc)
            g[f"U{d}"] = gu
            g[f"W{d}"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * h)
            g[f"c{d}"] = dz.sum((0, 1))
        return g

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 9) -> BiLstm:
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for r in range(rounds):
            order = rng.permutation(len(data))
            for k in range(0, len(order), batch):
                rows = [data[j] for j in order[k : k + batch]]
                x, on = _stacked([d[0] for d in rows])
                y, known = np.zeros(on.shape, np.float32), np.zeros(on.shape, np.float32)
                for j, (_, label, sure) in enumerate(rows):
                    y[: len(label), j], known[: len(label), j] = label, sure
                g = self.gradients(x, on, y, known)
                step += 1
                lr = rate * (1 - 0.9 * r / rounds)
                for key, v in self.p.items():
                    m1[key] = 0.9 * m1[key] + 0.1 * g[key]
                    m2[key] = 0.99 * m2[key] + 0.01 * g[key] ** 2
                    v -= lr * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]], cells: int = 12_000, piece: int = 1024) -> list[np.ndarray]:
        """Main or not for each block of each page; pages of similar length are read together.

        Inputs are worked out ``piece`` blocks at a time, for long pages once for
        each direction, so that a page takes some hundred bytes a block.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            end = k + 1
            while end < len(order) and (end - k + 1) * len(pages[order[end]]) <= cells:
                end += 1
            some = [pages[i] for i in order[k:end]]
            on = np.zeros((len(some[-1]), len(some)), bool)
            score = np.full(on.shape, self.p["o"][0], np.float32)
            for ways in ("fb",) if on.size <= cells else ("f", "b"):
                z = {d: np.zeros((*on.shape, 4 * self.hidden), np.float32) for d in ways}
                for j, page in enumerate(some):
                    on[: len(page), j] = True
                    for a in range(0, len(page), piece):
                        x = vectors_of(page, a, a + piece)
                        for d in ways:
                            z[d][a : a + len(x), j] = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
                        if "f" in ways:
                            score[a : a + len(x), j] += x @ self.p["S"]
                for d in ways:
                    part = slice(0, self.hidden) if d == "f" else slice(self.hidden, None)
                    score += self._run_on(z.pop(d), on, d, False)[0] @ self.p["V"][part]
            for j, i in enumerate(order[k:end]):
                out[i] = score[: len(pages[i]), j] >= 0
            k = end
        return out


def _stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, rows)), len(rows), WIDTH), np.float32)
    on = np.zeros(x.shape[:2], bool)
    for j, r in enumerate(rows):
        x[: len(r), j], on[: len(r), j] = r, True
    return x, on


# Words that layouts are made with, in classes and ids and in labels of boxes.
NEUTRAL = ["wrapper", "container", "page", "row", "col", "layout", "site", "inner", "grid", "block", "box", "section", "area", "panel", "center", "left", "right", "cell"]
_SAID = {
    "reply": ["Reply", "Antworten", "Répondre", "Responder", "Report", "Like", "Permalink"],
    "comments": ["Comments", "Kommentare", "Commentaires", "Comentarios", "comments", "Responses", "Leave a comment", "Join the discussion"],
    "form": ["Your name", "E-mail", "Send", "Subscribe", "Search", "Sign up", "Log in", "Submit"],
    "notice": ["We use cookies.", "Accept all", "This site uses cookies to give you the best experience.", "Please enable notifications.", "Subscribe to our newsletter", "Get the latest news by e-mail."],
    "legal": ["All rights reserved.", "© 2024", "Terms of use", "Privacy policy", "Imprint", "Contact", "Copyright"],
    "more": ["Read more", "Related articles", "You may also like", "Most read", "Share this", "Next page", "Previous", "Home", "About us"],
    "author": ["About the author", "Written by", "Follow on social media"],
}
#: Marks before a text of a made-up page: characters for private use, main and not.
_MARK = {1: "\ue000", 0: "\ue001"}


class _Layouts:
    """Made-up pages: texts of known labels under other elements and other names, in other orders.

    Main parts hold headings, paragraphs, lists, tables, quotations, code and
    captions. Names are those of MAIN_NAMES and OTHER_NAMES, neutral ones,
    invented ones or none, so that place, length and links must count too.
    """

    def __init__(self, main: list[str], other: list[str], rng: np.random.Generator):
        self.main, self.other, self.rng = main, other or main, rng

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def invented(self) -> str:
        return "".join(self.pick(["ba", "ro", "ti", "ku", "ven", "lo", "mi", "zar", "pel", "du"]) for _ in range(int(self.rng.integers(2, 4))))

    def words(self, texts: list[str], low: int, high: int) -> str:
        w = self.pick(texts).split()
        n = int(self.rng.integers(low, high + 1))
        a = int(self.rng.integers(0, max(1, len(w) - n)))
        return entities.escape(" ".join(w[a : a + n]) or "x", quote=False)

    def name(self, listed: list[str], how: str) -> str:
        kind = {"listed": lambda: self.pick(listed), "neutral": lambda: self.pick(NEUTRAL), "invented": self.invented, "none": lambda: ""}[how]()
        return f' {self.pick(["class", "id"])}="{kind}"' if kind else ""

    def how(self) -> str:
        return str(self.rng.choice(["listed", "neutral", "invented", "none"], p=[0.4, 0.15, 0.2, 0.25]))

    def el(self, tag: str, inside: str, attrs: str = "") -> str:
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def piece(self, y: int) -> str:
        """A part of a main text, or of a text that looks like one."""
        mark, main = _MARK[y], self.main
        long, short = (lambda: mark + self.words(main, 12, 90)), (lambda: mark + self.words(main, 2, 9))
        kind = int(self.rng.choice(12, p=[0.36, 0.1, 0.1, 0.08, 0.06, 0.06, 0.06, 0.05, 0.04, 0.03, 0.03, 0.03]))
        if kind == 0:
            text = long()
            return self.el("p", text + (f' <a href="#">{self.words(main, 1, 3)}</a> ' + self.words(main, 3, 20) if self.chance(0.2) else ""))
        if kind == 1:
            return self.el(self.pick(["h2", "h3", "h4", "h5", "h6"]), short())
        if kind == 2:
            tag = self.pick(["ul", "ol"])
            return self.el(tag, "".join(self.el("li", (long if self.chance(0.4) else short)()) for _ in range(int(self.rng.integers(2, 6)))))
        if kind == 3:
            rows = int(self.rng.integers(2, 5))
            cells = int(self.rng.integers(2, 4))
            return self.el("table", "".join(self.el("tr", "".join(self.el("th" if r == 0 and self.chance(0.6) else "td", mark + self.words(main, 1, 6)) for _ in range(cells))) for r in range(rows)))
        if kind == 4:
            return self.el("blockquote", self.el("p", long()) if self.chance(0.6) else long())
        if kind == 5:
            return self.el("pre", self.el("code", short()) if self.chance(0.5) else long())
        if kind == 6:
            return self.el("figure", self.el("figcaption", short()))
        if kind == 7:
            return self.el("dl", self.el("dt", short()) + self.el("dd", long()))
        if kind == 8:
            return self.el("div", long() + "<br><br>" + self.words(main, 5, 40))
        if kind == 9:
            return self.el("section", self.el("h2", short()) + self.el("p", long()), self.name(MAIN_NAMES, self.pick(["none", "neutral", "invented"])))
        if kind == 10:
            return self.el("p", short())
        return self.el("address", short()) if y == 0 else self.el("p", short() + ":") + self.el("ul", "".join(self.el("li", short()) for _ in range(3)))

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(self.el(tag, f'<a href="/x">{_MARK[0]}{self.words(self.other, 1, 5)}</a>') for _ in range(n))

    def outside(self, kind: str) -> str:
        """A part that is not main: ``top``, ``side``, ``inner`` (in the main part), ``after`` or ``bottom``."""
        m, r = _MARK[0], self.rng
        tag = {"top": ["header", "nav", "div", "div", "table"], "side": ["aside", "div", "div", "section"], "inner": ["aside", "div", "div", "form", "figure"], "after": ["section", "div", "div", "aside"], "bottom": ["footer", "footer", "div", "div"]}[kind]
        tag, said = self.pick(tag), (lambda key: m + self.pick(_SAID[key]))
        how = "listed" if kind == "inner" and tag in ("div", "figure") else self.how()
        attrs = self.name(OTHER_NAMES, how)
        if tag == "table":
            return self.el("table", self.el("tr", self.links(int(r.integers(3, 8)), "td")), attrs)
        n = int(r.integers(2, 9))
        choice = r.random() if kind != "inner" or self.chance(0.5) else 1.0
        if kind in ("top", "bottom") or choice < 0.25:
            inside = self.el("ul", self.links(n)) if self.chance(0.6) else "".join(f'<a href="/y">{m}{self.words(self.other, 1, 3)}</a> ' for _ in range(n))
            if kind == "top" and self.chance(0.5):
                inside = self.el(self.pick(["h1", "div", "p", "span"]), m + self.words(self.other, 1, 5)) + inside
            if kind == "bottom":
                inside += self.el(self.pick(["p", "div", "small"]), said("legal") + " " + self.words(self.other, 3, 20))
        elif kind == "after" and choice < 0.6:  # what readers say
            inside = self.el(self.pick(["h2", "h3", "p"]), f"{m}{int(r.integers(1, 40))} {self.pick(_SAID['comments'])}" if self.chance(0.5) else said("comments"))
            for _ in range(int(r.integers(1, 5))):
                head = self.el(self.pick(["b", "div", "span", "h4"]), m + self.words(self.other, 1, 2) + (f", {int(r.integers(1, 29))}.{int(r.integers(1, 12))}.2024" if self.chance(0.6) else ""))
                foot = f'<a href="#">{said("reply")}</a>' if self.chance(0.7) else ""
                inside += self.el(self.pick(["div", "li", "article", "div"]), head + self.el(self.pick(["p", "div"]), m + self.words(self.main, 3, 45)) + foot, self.name(["comment", "reply", "comment-body"], self.pick(["listed", "none", "invented"])))
        elif kind == "after" and choice < 0.8:
            inside = self.el(self.pick(["h3", "p", "div"]), said("author") + " " + self.words(self.other, 1, 2)) + self.el("p", m + self.words(self.main, 8, 30))
            attrs = self.name(["author", "bio", "about-author", "author-box"], self.pick(["listed", "none", "invented"]))
        elif choice < 0.5:
            inside = self.el(self.pick(["h3", "h4", "p"]), said("more")) + self.el("ul", self.links(n))
        elif choice < 0.65:
            return self.el("form", self.el("label", said("form")) + f"<input>{said('form')}" + self.el("button", said("form")), attrs)
        elif choice < 0.8:
            inside = self.el("p", said("notice")) + self.el("button", said("form"))
        elif how == "listed" or tag == "aside":
            text = m + self.words(self.pick([self.other, self.main]), 4, 30)
            inside = self.el(self.pick(["p", "div"]), text) if self.chance(0.6) else text
        else:
            inside = self.el("p", f'<a href="http://x">{m}{self.words(self.other, 4, 20)}</a>')
        return self.el(tag, inside, attrs)

    def page(self) -> str:
        r = self.rng
        box, how = self.pick(["article", "main", "div", "div", "div", "section", "td"]), self.how()
        body = self.el(self.pick(["h1", "h1", "h2"]), _MARK[1] + self.words(self.main, 3, 14)) if self.chance(0.85) else ""
        for _ in range(int(r.integers(3, 14))):
            body += self.piece(1)
            if self.chance(0.08):
                body += self.outside("inner")
        attrs = self.name(MAIN_NAMES, how if box in ("div", "section", "td") else self.pick(["none", "none", how]))
        if self.chance(0.3):
            body = self.el("div", body, self.name(MAIN_NAMES, self.how()))
        if self.chance(0.2):
            body += self.outside("after")
        main = self.el(box, body, attrs)
        sides = "".join(self.outside("side") for _ in range(int(r.integers(0, 3))))
        middle = main + sides if self.chance(0.6) else sides + main
        middle += "".join(self.outside("after") for _ in range(int(r.integers(0, 3)))) if self.chance(0.5) else ""
        if box == "td":
            middle = self.el("table", self.el("tr", (self.el("td", sides) if self.chance(0.5) else "") + main))
        for _ in range(int(r.integers(0, 3))):
            middle = self.el("div", middle, self.name(NEUTRAL, self.pick(["neutral", "none", "invented"])))
        top = "".join(self.outside("top") for _ in range(int(r.integers(0, 3))))
        if self.chance(0.3):
            top += self.el("div", self.el("p", _MARK[0] + self.pick(_SAID["notice"])), self.name(OTHER_NAMES, self.how()))
        end = "".join(self.outside("after") for _ in range(int(r.integers(0, 3)))) + "".join(self.outside("bottom") for _ in range(int(r.integers(0, 2))))
        title = self.el("head", self.el("title", _MARK[0] + self.words(self.main, 3, 12))) if self.chance(0.7) else ""
        return f"<html>{title}<body>{top}{middle}{end}</body></html>"

    def labelled(self) -> tuple[list[Block], list[int]]:
        blocks = blocks_of(self.page())
        marks = [0 if _MARK[0] in b.text else 1 for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace(_MARK[0], "").replace(_MARK[1], "").split()) or "x"
        return blocks, marks


def train_labeller(pages: list[str], made: int = 500, window: int = 64, rounds: int = 8, most_texts: int = 20_000, seed: int = 3) -> BiLstm:
    """Fit the labeller on the weak labels of ``pages`` and on ``made`` pages of other makes from their texts.

    At most ``most_texts`` texts of each label go into the made-up pages (a
    few fixed words if the pages have none); a page gives its first, last
    and one more window of blocks.
    """
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks_of, pages) if b]
    data, main, other = [], [], []

    def add(blocks: list[Block], marks: list[int | None]) -> None:
        starts = list(range(0, len(blocks), window))
        for a in {starts[0], starts[-1], starts[int(rng.integers(len(starts)))]}:
            y = np.array([m or 0 for m in marks[a : a + window]], np.float32)
            data.append((vectors_of(blocks, a, a + window), y, np.array([m is not None for m in marks[a : a + window]], np.float32)))

    for blocks in parsed:
        labels = [b.node.weak for b in blocks]
        add(blocks, labels)
        main += [b.text for b, y in zip(blocks, labels, strict=True) if y == 1]
        other += [b.text for b, y in zip(blocks, labels, strict=True) if y == 0]
    plain = [" ".join(x for said in _SAID.values() for x in said)]
    layouts = _Layouts(main[:most_texts] or plain, other[:most_texts], rng)
    for _ in range(made):
        add(*layouts.labelled())
    return BiLstm().fit(data, rounds)


def extract_main_text(pages: DataFrame, labeller: BiLstm) -> DataFrame:
    """``pages`` with ``text string``: the blocks labelled main, in page order, joined by a space.

    Null and empty html give an empty text; so does an empty table no rows.
    Rows that repeat a page_id, or have none, stand for themselves. Pages of
    any length are read whole; only scripts, styles and templates go before
    the blocks are labelled. A column already called text is replaced; others pass through.
    """
    model = pages.sparkSession.sparkContext.broadcast(labeller)
    others = [f for f in pages.schema.fields if f.name != "text"]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "html"):
                parsed = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
                main = model.value.label(parsed)
                texts = [" ".join(x.text for x, on in zip(b, m, strict=True) if on) for b, m in zip(parsed, main, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    return pages.mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType())]))


def fit_labeller(pages: DataFrame, bound: int = 120, most_bytes: int = 12 << 20) -> BiLstm:
    """A labeller from at most ``bound`` pages, chosen by a hash of their ids; none of more than its share of ``most_bytes`` is learnt from."""
    ids = [r[0] for r in pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(bound).collect()]
    small = pages.sparkSession.createDataFrame([(i,) for i in ids], pages.select("page_id").schema)
    short = pages.select("page_id", "html").where(F.octet_length("html") <= most_bytes // bound)
    rows = short.join(F.broadcast(small), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    return train_labeller([r["html"] or "" for r in sorted(rows, key=lambda r: (r["page_id"], r["html"] or ""))])


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract_main_text(pages, fit_labeller(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
