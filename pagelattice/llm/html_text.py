"""Operator 4: main text of web pages with a recurrent block labeller.

Method: a page is cut into leaf blocks (text between block-level tags, in page order). Each
block is a vector: its hashed tag path (names, classes and ids of all open elements), its
hashed words, and a few measures (length, link and punctuation shares, place on the page). A
bidirectional LSTM in numpy reads the whole sequence of a page's blocks, so every block is
labelled in the context of the document. The blocks labelled as main text are joined.

The model is trained here, with back-propagation through time and Adam, on ``PAGES`` pages
that ``sample_page`` makes up from markup conventions (menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around an article, with and without telling
names); a fixed seed gives the same weights each time. The weights have a fixed size.

A page of any length is labelled in the context of all its blocks: the states of both
directions are carried through a long page, which is held in stretches.

Defined results: null or empty html gives an empty text; a page without a block of main
text gives an empty text; tags are cut as the HTML standard's tokenizer cuts them; an element
that is never closed ends with the page, and so does an unclosed comment, script, style or tag;
foreign content (svg) ends with its end tag or where a tag of the page itself begins; rows are answered one by one, repeated rows alike; an
empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import html as entities
import random
import re
import string
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import ddl, fresh, quoted, table

PATH_SIZE, WORD_SIZE, HIDDEN = 96, 48, 24
PAGES, EPOCHS, SEED = 2400, 9, 5
#: Blocks that the network reads in one step of a long page; the states are carried from step to step.
STRETCH = 2000

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
FOREIGN = frozenset("svg math".split())
LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CONTAINERS = frozenset("article aside body button dd div fieldset figure footer form header html li main nav section td th ul ol".split())
#: Elements whose content is not part of what a reader sees.
HIDDEN_CONTENT = frozenset("template object canvas".split()) | FOREIGN

# Tags as the standard's tokenizer cuts them: a quote only opens a value right after "=", and a comment may end at once.
# Every part is possessive, so a tag is read once; one that the page ends in takes the rest of the page, as there.
SPACE = r"[\t\n\f\r ]"
ATTRIBUTE = rf"""=?+[^\t\n\f\r />=]*+(?:{SPACE}*+={SPACE}*+(?:"[^"]*+"|'[^']*+'|(?=>)|(?!["'])[^\t\n\f\r >]++))?+"""
TAG = re.compile(rf"<(?:(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:(?:{SPACE}|/)++|(?=[^>]){ATTRIBUTE})*+)>|(!--)|([!?][^>]*+>?+|/>|/(?![a-zA-Z])[^>]++>?+)|(/?[a-zA-Z]))")
COMMENT_END = re.compile(r"--!?>")
SCRIPT = re.compile(r"(<!--)|(-->)|<(/?)script(?=[\t\n\f\r />])", re.I)
NAMES = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]{2,}")


class Node:
    """A tag path: the open elements, each with the parts of its class, id and role; equal paths share their node."""

    __slots__ = ("children", "last", "sums", "vector")

    def __init__(self, above: Node | None = None, parts: tuple[str, ...] = ()):
        self.children: dict[tuple[str, ...], Node] = {}
        self.last = ((above.last if above else ()) + parts)[-2:]
        self.sums = above.sums.copy() if above else np.zeros(PATH_SIZE, np.float32)
        for p in parts:
            place, sign = _signed(p)
            self.sums[place] += sign
        self.vector: np.ndarray | None = None

    def below(self, parts: tuple[str, ...]) -> Node:
        found = self.children.get(parts)
        if found is None:
            found = self.children[parts] = Node(self, parts)
        return found

    def as_vector(self) -> np.ndarray:
        if self.vector is None:
            out = self.sums.copy()
            for p in self.last:  # the innermost names once more, apart
                place, sign = _signed("last" + p)
                out[place] += sign
            self.vector = np.clip(out, -2, 2)
        return self.vector


@lru_cache(50_000)
def _signed(part: str) -> tuple[int, float]:
    b = zlib.crc32(part.encode("utf-8", "surrogatepass"))
    return b % PATH_SIZE, 1.0 if b & 0x10000 else -1.0


@dataclass(slots=True)
class Block:
    path: Node
    text: str
    linked: int


def element(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the parts of its class, id and role."""
    out = [name]
    if attributes and "=" in attributes:
        for m in NAMES.finditer(attributes):
            out += [f".{p}" for p in PART.findall((m[1] or m[2] or m[3] or "").lower())[:6]]
    return tuple(out)


def raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of a raw element begins whose content begins at ``at``; the page's end if there is none."""
    if name == "script":  # a script inside a comment inside a script ends itself only
        comment = inner = False
        for m in SCRIPT.finditer(page, at):
            if m[1]:
                comment = True
            elif m[2]:
                comment = inner = False
            elif not m[3]:
                inner = comment
            elif inner:
                inner = False
            else:
                return m.start()
        return len(page)
    m = _closing(name).search(page, at)
    return m.start() if m else len(page)


@lru_cache(None)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I)


class Open:
    """The open elements of a page, with the places of each name, so that no tag looks through a deep page."""

    def __init__(self, root: Node):
        self.names: list[str] = []
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.hidden = 0

    def push(self, name: str, attributes: str) -> None:
        at = len(self.names)
        self.names.append(name)
        self.nodes.append(self.nodes[-1].below(element(name, attributes)))
        self.places.setdefault(name, []).append(at)
        if name in CONTAINERS:
            self.containers.append(at)
        self.hidden += name in HIDDEN_CONTENT

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()
            self.hidden -= name in HIDDEN_CONTENT

    def close(self, name: str) -> None:
        found = self.places.get(name)
        if found:
            self.cut(found[-1])

    def close_implied(self, name: str) -> None:
        """Ends an open ``name`` that no container other than itself separates from here."""
        found = self.places.get(name)
        if found and (not self.containers or self.containers[-1] <= found[-1]):
            self.cut(found[-1])

    def leave_foreign(self) -> None:
        at = min((p[0] for p in map(self.places.get, FOREIGN) if p), default=None)
        if at is not None:
            self.cut(at)


def blocks(page: str, root: Node | None = None) -> list[Block]:
    """The leaf blocks of a page in order, in linear time; white space is folded and references are decoded."""
    out: list[Block] = []
    stack = Open(root or Node())
    pieces: list[str] = []
    linked = links = at = 0

    def add(piece):
        nonlocal linked
        if not stack.hidden:
            if "&" in piece:
                piece = entities.unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(stack.nodes[-1], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    find = TAG.search
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[4]:
                if page.startswith((">", "->"), at):  # an empty comment
                    at = page.index(">", at) + 1
                else:
                    end = COMMENT_END.search(page, at)
                    at = end.end() if end else len(page)
            elif m[6]:
                at = len(page)
            continue
        name = name.lower()
        if name in INLINE:
            if stack.hidden and not m[1] and name in LEAVES_FOREIGN:
                stack.leave_foreign()
            if name == "a":
                links = 0 if m[1] else 1
            continue
        if name in RAW and not m[1]:
            if name != "noscript":
                flush()
            at = raw_end(page, name, at)
            continue
        flush()
        links = 0 if m[1] or name != "br" else links
        if m[1]:
            stack.close(name)
            continue
        if stack.hidden and name in LEAVES_FOREIGN:
            stack.leave_foreign()
        if name in VOID or name in FOREIGN and m[3].endswith("/"):
            continue
        if name in CLOSES_P:
            stack.close_implied("p")
        elif name == "li":
            stack.close_implied("li")
        stack.push(name, m[3])
    if at < len(page):
        add(page[at:])
    flush()
    return out


@lru_cache(200_000)
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


WORD = re.compile(r"\w+")
MEASURES = 9
SIZE = PATH_SIZE + WORD_SIZE + MEASURES


def vectors(page: list[Block], first: int = 0, end: int | None = None, total: int | None = None, before: int = 0) -> np.ndarray:
    """A row for each block from ``first`` to ``end``; ``total`` characters of the page, ``before`` of them before ``first``."""
    part = page[first:end]
    out = np.zeros((len(part), SIZE), np.float32)
    total = max(1, sum(len(b.text) for b in page)) if total is None else total
    for k, b in enumerate(part):
        row, text = out[k], b.text
        row[:PATH_SIZE] = b.path.as_vector()
        words = WORD.findall(text.lower())
        if words:
            counts = np.bincount([_bucket(w, WORD_SIZE) for w in words], minlength=WORD_SIZE)
            row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.sqrt(counts / len(words))
        n = len(text)
        row[PATH_SIZE + WORD_SIZE :] = (
            np.log1p(n) / 4,
            np.log1p(len(words)) / 3,
            b.linked / n,
            min(1.0, 10 * sum(map(text.count, ".,;:!?")) / n),
            text[-1] in ".!?:\"'",
            n / total,
            before / total,
            (first + k) / len(page),
            text[0] in "©&" or "©" in text,
        )
        before += n
    return out


class Labeller:
    """A bidirectional LSTM with one logistic output for each step."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "wo", "bo")

    def __init__(self, size: int = SIZE, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        self.p = {"wf": make(size, 4 * hidden), "uf": make(hidden, 4 * hidden), "bf": bias.copy(), "wb": make(size, 4 * hidden), "ub": make(hidden, 4 * hidden), "bb": bias.copy(), "wo": make(2 * hidden, 1)[:, 0], "bo": np.zeros(1, np.float32)}

    def _direction(self, x, mask, w, u, b, keep, state=None):
        """x: steps x pages x size. Hidden states of each step, and what the way back needs if ``keep``; else the last state."""
        steps, pages, _ = x.shape
        h, c = state or (np.zeros((pages, self.hidden), np.float32), np.zeros((pages, self.hidden), np.float32))
        states, store = np.zeros((steps, pages, self.hidden), np.float32), []
        driven = x @ w + b
        n = self.hidden
        for t in range(steps):
            z = driven[t] + h @ u
            gates = 1 / (1 + np.exp(-z[:, : 3 * n]))
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                store.append((h, c, i, f, o, g, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            states[t] = h
        return states, store if keep else (h, c)

    def forward(self, x, mask, keep=False):
        p = self.p
        ahead, sa = self._direction(x, mask, p["wf"], p["uf"], p["bf"], keep)
        back, sb = self._direction(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], keep)
        both = np.concatenate([ahead, back[::-1]], 2)
        return both @ p["wo"] + p["bo"], both, sa, sb

    def _back(self, x, store, u, dh_out):
        steps, n = len(store), self.hidden
        dw, du, db = np.zeros((x.shape[2], 4 * n), np.float32), np.zeros_like(u), np.zeros(4 * n, np.float32)
        dh, dc = np.zeros_like(store[0][0]), np.zeros_like(store[0][0])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = store[t]
            dh = dh + dh_out[t]
            dn = np.where(m, dh, 0)
            dnew = np.where(m, dc, 0) + dn * o * (1 - tc * tc)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dn * tc * o * (1 - o), dnew * i * (1 - g * g)], 1)
            dw += x[t].T @ dz
            du += h.T @ dz
            db += dz.sum(0)
            dh = dz @ u.T + np.where(m, 0, dh)
            dc = dnew * f + np.where(m, 0, dc)
        return dw, du, db

    def gradients(self, x, mask, y):
        logits, both, sa, sb = self.forward(x, mask, True)
        p = 1 / (1 + np.exp(-logits))
        n = mask.sum()
        d = np.where(mask, p - y, 0).astype(np.float32) / n
        loss = float(-(np.where(mask, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0)).sum() / n)
        dboth = d[:, :, None] * self.p["wo"]
        grads = {"wo": np.einsum("tp,tph->h", d, both), "bo": d.sum(keepdims=True).reshape(1)}
        h = self.hidden
        grads["wf"], grads["uf"], grads["bf"] = self._back(x, sa, self.p["uf"], dboth[:, :, :h])
        grads["wb"], grads["ub"], grads["bb"] = self._back(x[::-1], sb, self.p["ub"], dboth[::-1, :, h:])
        return loss, grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int = SEED, rate: float = 0.01) -> float:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            if epoch == epochs - 2:
                rate /= 4
            for x, mask, y, _ in _padded(pages, 32, rng):
                step += 1
                loss, grads = self.gradients(x, mask, y)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return loss

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page whether each block is main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        short = [k for k, p in enumerate(pages) if 0 < len(p) <= STRETCH]
        for x, mask, _, which in _padded([(vectors(pages[k]), np.zeros(len(pages[k]), np.float32)) for k in short], 64, None):
            logits = self.forward(x, mask)[0] > 0
            for column, w in enumerate(which):
                out[short[w]] = logits[: len(pages[short[w]]), column]
        for k, p in enumerate(pages):
            if len(p) > STRETCH:
                out[k] = self.label_long(p)
        return out

    def label_long(self, page: list[Block], stretch: int = STRETCH) -> np.ndarray:
        """As a page read whole, in memory for one stretch: each direction hands its state on from stretch to stretch."""
        sizes = np.cumsum([0, *(len(b.text) for b in page)])
        logits = np.full(len(page), self.p["bo"][0], np.float32)
        parts = [(i, min(i + stretch, len(page))) for i in range(0, len(page), stretch)]
        for parts, way, names, weights in ((parts, 1, ("wf", "uf", "bf"), self.p["wo"][: self.hidden]), (parts[::-1], -1, ("wb", "ub", "bb"), self.p["wo"][self.hidden :])):
            state = None
            for i, j in parts:
                x = vectors(page, i, j, max(1, int(sizes[-1])), int(sizes[i]))[::way, None]
                states, state = self._direction(x, np.ones((j - i, 1), bool), *(self.p[n] for n in names), False, state)
                logits[i:j] += (states[:, 0] @ weights)[::way]
        return logits > 0


def _padded(pages, size, rng):
    """Batches of pages of like length: steps x pages x size, mask, labels, page numbers."""
    order = np.argsort([len(x) for x, _ in pages], kind="stable")
    groups = [order[i : i + size] for i in range(0, len(order), size)]
    if rng is not None:
        rng.shuffle(groups)
    for group in groups:
        steps = max(len(pages[k][0]) for k in group)
        x = np.zeros((steps, len(group), SIZE), np.float32)
        mask, y = np.zeros((steps, len(group)), bool), np.zeros((steps, len(group)), np.float32)
        for column, k in enumerate(group):
            n = len(pages[k][0])
            x[:n, column], mask[:n, column], y[:n, column] = pages[k][0], True, pages[k][1]
        yield x, mask, y, group


def _words(rng: random.Random, n: int, vocabulary: list[str]) -> str:
    out = []
    for _ in range(n):
        w = rng.choice(vocabulary) if rng.random() < 0.9 else rng.choice(vocabulary) + rng.choice(vocabulary)
        out.append(w + rng.choice(["", "", "", "", ",", ""]))
    return " ".join(out)


def _sentences(rng, n, vocabulary):
    return " ".join(_words(rng, rng.randrange(2, 18), vocabulary).capitalize() + rng.choice([".", ".", ".", "?", "!", ""]) for _ in range(n))


def sample_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and its main blocks: conventional markup, wording mostly random."""
    syllables = [rng.choice("bcdfghlmnprstvwzñçß") + rng.choice("aeiouéèüóä") + rng.choice(["", "n", "r", "s", "l", "t"]) for _ in range(30)]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    main: list[str] = []
    site = _words(rng, rng.randrange(1, 4), vocabulary).replace(",", "")
    named = rng.random() < 0.85  # does the markup tell?
    junk = rng.random() * 0.6

    def attribute(*names):
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if named or rng.random() < 0.3 else ""

    def inline(text):
        if rng.random() < 0.25 and " " in text:
            a, b = text.split(" ", 1)
            tag = rng.choice(["b", "i", "em", "strong", 'a href="/x"', "span"])
            return f"<{tag}>{a}</{tag.split()[0]}> {b}" if rng.random() < 0.8 else f"<{tag.split()[0] if tag[0] == 'a' else tag}>{text}"
        return text

    def body_text():
        kind = rng.random()
        if junk < 0.08:
            marks = [entities.escape(rng.choice(string.punctuation) * rng.randrange(1, 5)) for _ in range(4)]
            return " ".join(w + rng.choice(marks) for w in _words(rng, rng.randrange(3, 40), vocabulary).split())
        if junk < 0.16:
            return f" {entities.escape(rng.choice(string.punctuation))} ".join(_words(rng, rng.randrange(3, 30), vocabulary).split())
        if junk < 0.16 + 0.08 * (rng.random() < 0.8):
            return (rng.choice(vocabulary) + " ") * rng.randrange(3, 60)
        if kind < 0.12:
            return _words(rng, rng.randrange(1, 4), vocabulary).capitalize() + "."
        return _sentences(rng, rng.randrange(1, 14), vocabulary)

    def short(n=4):
        return _words(rng, rng.randrange(1, n), vocabulary)

    def links(n):
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (short(3) for _ in range(n)))

    def menu():
        tag = rng.choice(["nav", "nav", "div" + attribute("menu", "navbar", "nav main-nav", "breadcrumb", "navigation"), "ul" + attribute("menu", "nav")])
        inner = f"<ul>{links(rng.randrange(2, 9))}</ul>" if tag.split()[0] != "ul" else links(rng.randrange(2, 9))
        if tag.split()[0] != "ul" and rng.random() < 0.25:
            inner = rng.choice([" ", " | ", ""]).join(f'<a href="/{w}">{w}</a>' for w in (short(3) for _ in range(rng.randrange(1, 9))))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def header():
        tag = rng.choice(["header", "header", "div" + attribute("header", "masthead", "top-bar", "site-header")])
        return f"<{tag}>{rng.choice(['<h1>', '<h2>', '<a href=/>', '<p>'])}{site}{rng.choice(['', '<p>' + short(8)])}</{tag.split()[0]}>"

    def advert():
        tag = "div" + f' class="{rng.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"])}"'
        return f"<!-- ad --><{tag}>{rng.choice(['', '<p>', '<a href=/ad>'])}{_sentences(rng, rng.randrange(1, 4), vocabulary)}</div>"

    def notice():
        tag = rng.choice(["div", "section", "aside"]) + f' class="{rng.choice(["cookie-notice", "notice", "cookie-banner", "consent", "alert notice", "newsletter", "popup", "gdpr"])}"'
        return f"<{tag}><p>{rng.choice(['We use cookies. ', 'Cookies: ', 'Subscribe to our newsletter. ', ''])}{_sentences(rng, rng.randrange(1, 4), vocabulary)}</p>{rng.choice(['', '<button>OK</button>', '<button>Accept</button>'])}</{tag.split()[0]}>"

    def sidebar():
        tag = rng.choice(["aside", "aside", "div" + f' class="{rng.choice(["sidebar", "widget", "related", "side-bar", "recent-posts", "share"])}"'])
        return f"<{tag}><h3>{rng.choice(['Related', 'Popular', short(4)])}</h3>{rng.choice(['<ul>' + links(rng.randrange(2, 7)) + '</ul>', '<p>' + _sentences(rng, rng.randrange(1, 4), vocabulary) + '</p>'])}</{tag.split()[0]}>"

    def form():
        return f"<form{attribute('search', 'login', 'subscribe', 'contact')}><label>{short(4)}</label><input type=text>{rng.choice(['<p>' + _sentences(rng, 1, vocabulary) + '</p>', ''])}<select><option>{short(3)}<option>{short(3)}</select><button>{rng.choice(['Send', 'Search', short(3)])}</button></form>"

    def comments():
        tag = rng.choice(["section", "div", "ol"]) + f' {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "responses", "reader-comments"])}"'
        one = "".join(f'<{k} class="{rng.choice(["comment", "comment-body", "reply"])}"><p>{rng.choice(["", f"<b>{short(3)}</b> "])}{_sentences(rng, rng.randrange(1, 5), vocabulary)}</p></{k}>' for k in [rng.choice(["div", "article", "li"])] * rng.randrange(1, 6))
        return f"<{tag}><h3>{rng.choice(['Comments', short(3)])}</h3>{one}</{tag.split()[0]}>"

    def footer():
        tag = rng.choice(["footer", "footer", "footer", "div" + f' class="{rng.choice(["footer", "site-footer", "copyright", "bottom"])}"'])
        return f"<{tag}>{rng.choice(['', '<p>'])}{rng.choice(['&copy; ', 'Copyright ', '', '&copy; '])}{site} {rng.choice(['&middot; ', '2020 ', ''])}{_sentences(rng, rng.randrange(0, 5), vocabulary)}{rng.choice(['', '<ul>' + links(3) + '</ul>'])}</{tag.split()[0]}>"

    def article():
        tag = rng.choice(["article", "article", "article", "main", "div" + f' class="{rng.choice(["content", "post", "entry-content", "article-body", "story", "post-content", "main-content"])}"', 'div id="content"'])
        out = []

        def add(markup, text, end=True):
            main.append(" ".join(entities.unescape(re.sub("<[^>]*>", "", text)).split()))
            out.append(f"<{markup}>{text}" + (f"</{markup.split()[0]}>" if end else ""))

        if rng.random() < 0.85:
            add("h1", rng.choice([short(12), _sentences(rng, 1, vocabulary)]))
        sloppy = rng.random() < 0.4
        for _ in range(rng.randrange(0 if main else 1, 12)):
            kind = rng.random()
            if kind < 0.75:
                add("p", inline(body_text()), not sloppy or rng.random() < 0.6)
            elif kind < 0.82:
                add(rng.choice(["h2", "h3"]), short(8))
            elif kind < 0.88:
                out.append("<ul>")
                for _ in range(rng.randrange(2, 5)):
                    add("li", body_text()[:120].rsplit("&", 1)[0])
                out.append("</ul>")
            elif kind < 0.92:
                add("blockquote", body_text())
            elif kind < 0.96:
                out.append("<table><tr>")
                add("td", short(4))
                add("td", short(4))
                out.append("</tr></table>")
            else:
                out.append(rng.choice([advert, notice])())
        return f"<{tag}>{''.join(out)}</{tag.split()[0]}>"

    before = [f() for f in (notice, header, menu, advert, form, menu) if rng.random() < 0.45]
    rng.shuffle(before)
    after = [f() for f in (advert, comments, sidebar, form, notice) if rng.random() < 0.35]
    rng.shuffle(after)
    middle = [sidebar()] if rng.random() < 0.2 else []
    whole = rng.random() < 0.93 or not before + middle + after  # else a page without an article
    body = "".join([*before, *middle, article() if whole else "", *after, footer() if rng.random() < 0.85 else ""])
    page = f"<!DOCTYPE html><html><head><title>{site}</title><style>p{{}}</style></head><body>{body}"
    return page + ("</body></html>" if rng.random() < 0.8 else ""), main


@lru_cache(1)
def trained() -> Labeller:
    rng = random.Random(SEED)
    pages, root = [], Node()
    for _ in range(PAGES):
        page, main = sample_page(rng)
        found = blocks(page, root)
        wanted = list(main)
        labels = np.zeros(len(found), np.float32)
        for k, b in enumerate(found):  # the main blocks in order
            if wanted and b.text == wanted[0]:
                labels[k] = 1
                wanted.pop(0)
        if found and not wanted:
            pages.append((vectors(found), labels))
    model = Labeller()
    model.train(pages, EPOCHS)
    return model


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    root = Node()
    found = [blocks(p, root) if p else [] for p in pages]
    labels = model.label(found)
    return [" ".join([b.text for b, main in zip(own, label.tolist()) if main]) for own, label in zip(found, labels)]


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", rows: int = 256) -> DataFrame:
    """The columns ``keep`` of each row with ``text`` and ``n_chars``; one pass without a shuffle."""
    weights = trained().p
    (source,) = fresh(keep, "html_")
    answered = [*keep, *fresh(keep, "text", "n_chars")]

    def run(batches):
        model = Labeller()
        model.p = weights
        for batch in batches:
            column = batch.column(len(keep))
            texts = []
            for i in range(0, len(column), rows):
                texts += extract(column.slice(i, rows).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], answered)

    kept = [F.col(quoted(k)) for k in keep]
    return pages.select(*kept, F.col(quoted(html)).cast("string").alias(source)).mapInArrow(run, ddl(pages.select(*kept), f"{answered[-2]} string, {answered[-1]} long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return main_text(pages)
