"""Main text of web pages: a bidirectional LSTM in numpy labels the sequence of a page's text blocks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the hashed vectors of the tag path, the innermost tag and the words, and of one LSTM's state.
PATH_SIZE, LEAF_SIZE, WORD_SIZE, HIDDEN = 48, 16, 32, 16
NUMBERS = 4
FEATURES = PATH_SIZE + LEAF_SIZE + WORD_SIZE + NUMBERS
#: The made-up pages that the labeller learns from.
TRAIN_PAGES, EPOCHS, BATCH, RATE = 1600, 6, 40, 0.02
#: Blocks that are labelled together.
BATCH_BLOCKS = 8192

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg path picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open one of the given kinds.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements whose content is no text of the page: to the end of the page if they stay open, and only where they are closed.
RAW, SHUT = frozenset(["script", "style"]), frozenset(["template", "noscript", "iframe", "svg"])
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>")
_CLOSING = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW | SHUT}
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class _Page:
    """Where the tags of a page end. No search runs to the end of the page twice in vain, so a page takes time in proportion to its length."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.open_to_end: set[str] = set()
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def tag_end(self, at: int) -> int:
        """Behind the tag whose attributes begin at at. A > in quotes does not end it, unless no other does."""
        if self.places is None:
            if found := _ATTRIBUTES.match(self.html, at):
                return found.end()
            self._all_ends()
        k = bisect_left(self.places, at)
        return self.ends[k] or self.html.index(">", at) + 1

    def _all_ends(self) -> None:
        """For each quote and >, the end of a tag that it is in; 0 if there is none. From the last to the first."""
        self.places = [m.start() for m in re.finditer("[>\"']", self.html)]
        self.ends = [0] * (len(self.places) + 1)
        following: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            mark = self.html[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k] + 1
            else:
                self.ends[k] = self.ends[following[mark] + 1] if mark in following else 0
                following[mark] = k

    def closing(self, name: str, at: int) -> int:
        """Behind the next closing tag of that name, or 0."""
        if name in self.open_to_end:
            return 0
        if found := _CLOSING[name].search(self.html, at):
            return found.end()
        self.open_to_end.add(name)
        return 0


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes) of a page in order; kind is text, open or close. Comments, declarations, self-closed and closed SHUT elements and RAW ones are left out."""
    page, at = _Page(html), 0
    while at < len(html):
        begin = html.find("<", at)
        if begin < 0 or begin > page.last and not html.startswith("<!--", begin):
            yield "text", html[at:], ""
            return
        if begin > at:
            yield "text", html[at:begin], ""
        if html.startswith("<!--", begin):
            at = html.find("-->", begin + 4) + 3
            if at < 3:
                return
            continue
        if html[begin + 1 : begin + 2] in ("!", "?"):
            at = html.index(">", begin) + 1
            continue
        found = _TAG.match(html, begin)
        if not found:
            yield "text", "<", ""
            at = begin + 1
            continue
        tag, at = found[1].lower(), page.tag_end(found.end())
        attributes = html[found.end() : at - 1]
        if html[begin + 1] == "/":
            yield "close", tag, ""
        elif tag in RAW:
            at = page.closing(tag, at) or len(html)
        elif tag == "svg" and attributes.endswith("/"):
            continue
        elif tag in SHUT and (behind := page.closing(tag, at)):
            at = behind
        else:
            yield "open", tag, attributes


class Place:
    """An open element: its tag and names, the one around it, and the slots of PATH_SIZE that names from the root to here fall into, as bits."""

    __slots__ = ("tag", "names", "around", "bits")

    def __init__(self, tag: str, names: tuple[str, ...], around: Place | None):
        self.tag, self.names, self.around = tag, names, around
        self.bits = around.bits if around else 0
        for name in (tag, *names):
            self.bits |= 1 << _slot(name, PATH_SIZE)


class Block:
    """A run of text without a block-level tag in it: its text, where it is, and how much of it is links."""

    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Place | None, linked: int):
        self.text, self.place, self.linked = text, place, linked

    @property
    def path(self) -> tuple[str, ...]:
        """Tags and names from the root inward."""
        parts: list[str] = []
        place = self.place
        while place:
            parts += [*reversed(place.names), place.tag]
            place = place.around
        return tuple(reversed(parts))


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, with references decoded and white space collapsed; none are empty."""
    out: list[Block] = []
    stack: list[Place] = []
    held: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, linked))
        parts.clear()
        linked = 0

    for kind, tag, attributes in tokens(html):
        if kind == "text":
            text = unescape(tag)
            parts.append(text)
            linked += len(text) if links > 0 else 0
            continue
        if tag == "a":
            links = int(kind == "open")
        if tag == "br":
            parts.append(" ")
        if tag in INLINE or tag == "br":
            continue
        end()
        if kind == "close":
            links = 0
            while held[tag]:
                shut = stack.pop().tag
                held[shut] -= 1
                if shut == tag:
                    break
        elif tag not in VOID:
            if stack and stack[-1].tag in ENDS.get(tag, ()):
                held[stack.pop().tag] -= 1
            names = tuple(f".{w}" for m in _NAMES.finditer(attributes) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower()) if w)
            stack.append(Place(tag, names, stack[-1] if stack else None))
            held[tag] += 1
    end()
    return out


@cache
def _slot(name: str, size: int) -> int:
    return xxhash.xxh32_intdigest(name) % size


class _WordSlots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word) % WORD_SIZE
        return value


_WORD_SLOTS = _WordSlots()


def vectors(page: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    out = np.zeros((len(page), FEATURES), np.float32)
    for row, block in zip(out, page):
        bits = block.place.bits if block.place else 0
        row[:PATH_SIZE] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little")
        row[PATH_SIZE + _slot(block.place.tag if block.place else "", LEAF_SIZE)] = 1
        words = list(map(_WORD_SLOTS.__getitem__, block.text.lower().split()))
        if words:
            row[PATH_SIZE + LEAF_SIZE : -NUMBERS] = np.bincount(words, minlength=WORD_SIZE) / len(words) * 4
        n = len(block.text)
        row[-NUMBERS:] = (np.log1p(n) / 4, min(1.0, block.linked / n), min(1.0, sum(map(block.text.count, ".,;:!?")) * 10 / n), min(1.0, len(words) / 20))
    return out


class Labeller:
    """Two LSTMs over a page's blocks, one from each end, and a logistic unit on both states."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{k}{d}": draw(n, 4 * HIDDEN) for d in "fb" for k, n in (("x", FEATURES), ("h", HIDDEN))}
        for d in "fb":
            self.p[f"c{d}"] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)
        self.p |= {"w": draw(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, d: str, carried: tuple | None = None, trace: list | None = None) -> tuple[np.ndarray, tuple]:
        """States (pages, blocks, HIDDEN) and the last (h, c); trace, if given, gets what the way back needs."""
        n, length, _ = x.shape
        pre = x.reshape(n * length, -1) @ self.p[f"x{d}"] + self.p[f"c{d}"]
        pre = pre.reshape(n, length, -1)
        h, c = carried or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        states = np.empty((n, length, HIDDEN), np.float32)
        for t in range(length):
            z = pre[:, t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            states[:, t] = h
            if trace is not None:
                trace.append((i, f, o, g, s, before))
        return states, (h, c)

    @staticmethod
    def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's blocks in reverse order, the filling still at the end."""
        steps = np.arange(x.shape[1])
        at = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
        return np.take_along_axis(x, at[:, :, None], axis=1)

    def forward(self, x: np.ndarray, lengths: np.ndarray, trace: tuple[list, list] = (None, None)) -> tuple[np.ndarray, tuple]:
        """Probability per block of being main text."""
        turned = self._reversed(x, lengths)
        one = self._run(x, "f", trace=trace[0])[0]
        two = self._run(turned, "b", trace=trace[1])[0]
        states = np.concatenate([one, self._reversed(two, lengths)], axis=2)
        scores = (states @ self.p["w"])[:, :, 0] + self.p["bias"]
        return 1 / (1 + np.exp(-scores)), (x, turned, states)

    def label_long(self, page: list[Block]) -> np.ndarray:
        """Which blocks of one page are main text; only a part of its vectors is held at a time, and one number per block and direction."""
        scores = np.full(len(page), self.p["bias"][0], np.float32)
        for d, weights, order in (("f", self.p["w"][:HIDDEN], 1), ("b", self.p["w"][HIDDEN:], -1)):
            carried = None
            for at in range(0, len(page), BATCH_BLOCKS):
                some = range(len(page))[::order][at : at + BATCH_BLOCKS]
                states, carried = self._run(vectors([page[k] for k in some])[None], d, carried)
                scores[some[0] : some[-1] + order if some[-1] + order >= 0 else None : order] += (states[0] @ weights)[:, 0]
        return scores > 0

    def _back(self, x: np.ndarray, d: str, trace: list, grad: np.ndarray, g_out: dict) -> None:
        n, length, _ = x.shape
        dz_all = np.empty((n, length, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        weights = np.zeros_like(self.p[f"h{d}"])
        for t in range(length - 1, -1, -1):
            i, f, o, g, s, (h_before, c_before) = trace[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            weights += h_before.T @ dz
            dh = dz @ self.p[f"h{d}"].T
            dc = dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        g_out |= {f"x{d}": x.reshape(len(flat), -1).T @ flat, f"c{d}": flat.sum(axis=0), f"h{d}": weights}

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        trace_f, trace_b = [], []
        probability, (x, turned, states) = self.forward(x, lengths, (trace_f, trace_b))
        real = np.arange(x.shape[1]) < lengths[:, None]
        error = np.where(real, probability - y, 0).astype(np.float32)[:, :, None] / real.sum()
        g = {"w": (states * error).sum(axis=(0, 1))[:, None], "bias": error.sum(axis=(0, 1))}
        into = error * self.p["w"][:, 0]
        self._back(x, "f", trace_f, into[:, :, :HIDDEN], g)
        self._back(turned, "b", trace_b, self._reversed(into[:, :, HIDDEN:], lengths), g)
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 0) -> Labeller:
        """Adam; the same pages give the same weights."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                x, lengths = padded([pages[k] for k in some])
                y = padded([labels[k][:, None] for k in some])[0][:, :, 0]
                step += 1
                for k, g in self.gradients(x, y, lengths).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Per page, which of its blocks are main text. Pages of like length go together, long ones by themselves."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            if longest > BATCH_BLOCKS:
                k = order.pop()
                out[k] = self.label_long(pages[k])
                continue
            some = [order.pop() for _ in range(min(len(order), max(1, BATCH_BLOCKS // longest)))]
            x, lengths = padded([vectors(pages[k]) for k in some])
            for k, p in zip(some, self.forward(x, lengths)[0]):
                out[k] = p[: len(pages[k])] > 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    out = np.zeros((len(pages), lengths.max(), pages[0].shape[1]), np.float32)
    for row, page in zip(out, pages):
        row[: len(page)] = page
    return out, lengths


class PageMaker:
    """Made-up pages with a label per text block, of many layouts: with telling tags and names, and without."""

    def __init__(self, seed: int = 0):
        self.rng = np.random.default_rng(seed)

    def some(self, *choices):
        return choices[self.rng.integers(len(choices))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        letters = "aeiouáéöüè" if self.chance(0.2) else "aeiou"
        return "".join(self.some(*"bcdfghklmnprstvwz") + self.some(*letters) for _ in range(self.rng.integers(1, 4))) + self.some("", "", "n", "s")

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.integers(low, high)))

    def prose(self, low: int = 5, high: int = 60) -> str:
        sentences = []
        left = int(self.rng.integers(low, high))
        while left > 0:
            n = int(self.rng.integers(3, 16))
            sentences.append(self.words(n, n + 1).capitalize().replace(" ", ", ", int(self.chance(0.4))) + self.some(".", ".", ".", "?", "!"))
            left -= n
        return " ".join(sentences)

    def tag(self, name: str, *classes: str) -> str:
        return f'<{name} {self.some("class", "class", "id")}="{self.some(*classes)}">' if classes and self.chance(0.85) else f"<{name}>"

    def links(self, n: int, words: int = 3) -> list[tuple[str, int]]:
        return [(f'<li><a href="/{self.word()}">{self.words(1, words)}</a></li>', 0) for _ in range(n)]

    def wrapped(self, name: str, classes: tuple[str, ...], inside: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
        return [(self.tag(name, *classes), None), *inside, (f"</{name}>", None)]

    def article(self) -> list[tuple[str, int | None]]:
        out: list[tuple[str, int | None]] = [(f"<h1>{self.words(2, 12)}</h1>", 1)] if self.chance(0.85) else []
        for _ in range(self.rng.integers(1, 14)):
            kind = self.rng.random()
            if kind < 0.5:
                out.append(self.paragraph())
            elif kind < 0.56:
                out += [(f"<p>{self.prose(1, 8)}</p>", 1) for _ in range(self.rng.integers(3, 25))]
            elif kind < 0.62:
                out.append((f"<{(t := self.some('h2', 'h3'))}>{self.words(1, 8)}</{t}>", 1))
            elif kind < 0.68:
                t = self.some("ul", "ul", "ol")
                out += [(f"<{t}>", None), *((f"<li>{self.prose(3, 20)}</li>", 1) for _ in range(self.rng.integers(1, 7))), (f"</{t}>", None)]
            elif kind < 0.72:
                out.append((f"<blockquote>{self.prose()}</blockquote>", 1))
            elif kind < 0.78:
                out += self.grid()
            elif kind < 0.82:
                out.append(("<pre>" + "\n".join(self.some(self.prose(3, 12), f"{self.word()} = {self.word()}({self.word()})") for _ in range(self.rng.integers(1, 6))) + "</pre>", 1))
            elif kind < 0.86:
                out += [(f'<figure><img src="{self.word()}.jpg">', None), (f"<figcaption>{self.prose(3, 40)}</figcaption>", 1), ("</figure>", None)]
            elif kind < 0.9:
                pairs = [x for _ in range(self.rng.integers(1, 5)) for x in ((f"<dt>{self.words(1, 4)}</dt>", 1), (f"<dd>{self.prose(3, 30)}</dd>", 1))]
                out += [("<dl>", None), *pairs, ("</dl>", None)]
            elif kind < 0.95:
                out.append(self.linked())
            elif kind < 0.975:
                out += self.wrapped("div", ("share", "social share", "share-buttons"), self.links(3, 2))
            else:
                out += self.advert()
        return [*out, self.linked()] if self.chance(0.15) else out

    def linked(self) -> tuple[str, int]:
        """A paragraph of which most is links."""
        links = " ".join(f'<a href="/{self.word()}">{self.words(1, 8)}</a>{self.some("", ",", " " + self.words(1, 3))}' for _ in range(self.rng.integers(2, 7)))
        return f"<p>{self.some('', self.prose(2, 8))} {links}{self.some('', '.', ' ' + self.prose(2, 10))}</p>", 1

    def paragraph(self) -> tuple[str, int]:
        open_p = self.some("<p>", "<p>", "<p>", "<p><b>", "<div>")
        shut = "</div>" if open_p == "<div>" else self.some("</p>", "</p>", "</p>", "<br>" if open_p == "<p><b>" else "</p>")
        text = self.prose(1, 120)
        if self.chance(0.15):
            text = text.replace(" ", f' <a href="/x">{self.word()}</a> ', 1)
        return f"{open_p}{text}{shut}", 1

    def grid(self) -> list[tuple[str, int | None]]:
        """A table of the article: short cells or whole sentences."""
        cell = self.some(lambda: self.words(1, 4), lambda: self.prose(3, 25))
        out: list[tuple[str, int | None]] = [("<table>", None)]
        wide = self.rng.integers(2, 5)
        for row in range(self.rng.integers(2, 6)):
            t = "th" if row == 0 and self.chance(0.5) else "td"
            out += [("<tr>", None), *((f"<{t}>{cell()}</{t}>", 1) for _ in range(wide)), ("</tr>", None)]
        return [*out, ("</table>", None)]

    def advert(self) -> list[tuple[str, int | None]]:
        text = self.some(self.prose(3, 40), f"Advertisement {self.words(2, 8)}", f"Sponsored: {self.words(3, 10)}", self.prose(3, 20) + "\n" + self.prose(3, 10))
        return [(f'<{(n := self.some("div", "div", "aside", "section"))} {self.some("class", "id")}="{self.some("ad", "ads", "advert", "banner ad", "ad-slot", "promo", "sponsored")}">{text}</{n}>', 0)]

    def menu(self) -> list[tuple[str, int | None]]:
        items = [("<ul>", None), *self.links(self.rng.integers(2, 9)), ("</ul>", None)]
        return self.wrapped(self.some("nav", "nav", "nav", "div"), ("nav", "menu", "navbar", "main-menu", "breadcrumbs"), items) if self.chance(0.9) else items

    def head(self) -> list[tuple[str, int | None]]:
        inside = [(f"<{(t := self.some('p', 'div', 'h2'))}>{self.words(1, 6)}</{t}>", 0)] + (self.menu() if self.chance(0.4) else [])
        return self.wrapped(self.some("header", "div"), ("header", "site-header", "masthead", "topbar"), inside)

    def notice(self) -> list[tuple[str, int | None]]:
        text = self.some("We use cookies to improve this site. ", "Subscribe to our newsletter. ", "Please log in to continue. ", "Accept all cookies. ", "") + self.prose(3, 25)
        return self.wrapped("div", ("cookie-notice", "notice", "alert", "consent", "newsletter", "popup", "subscribe"), [(f"<p>{text}</p>", 0)])

    def side(self) -> list[tuple[str, int | None]]:
        inside: list[tuple[str, int | None]] = [(f"<h3>{self.some('Related', 'Popular', 'Archive', 'Tags', self.words(1, 3))}</h3>", 0), ("<ul>", None), *self.links(self.rng.integers(1, 7), 8), ("</ul>", None)]
        if self.chance(0.5):
            inside.append((f"<p>{self.prose(3, 40)}</p>", 0))
        return self.wrapped(self.some("aside", "aside", "div"), ("sidebar", "widget", "related", "side-bar", "recommended"), inside)

    def form(self) -> list[tuple[str, int | None]]:
        return [("<form>", None), (f"<label>{self.words(1, 4)}</label><input>", 0), (f"<button>{self.some('Search', 'Send', 'Submit', self.word())}</button>", 0), ("</form>", None)]

    def comments(self) -> list[tuple[str, int | None]]:
        inside: list[tuple[str, int | None]] = [(f"<h3>{self.some('Comments', '3 comments', 'Replies', 'Responses', self.words(1, 3))}</h3>", 0)]
        for _ in range(self.rng.integers(1, 6)):
            inside += self.wrapped("div", ("comment", "comment-body", "reply"), [(f"<p>{self.prose(3, 60)}</p>", 0)])
        return self.wrapped(self.some("section", "div"), ("comments", "comment-list", "discussion", "responses"), inside)

    def foot(self) -> list[tuple[str, int | None]]:
        text = self.some(f"&copy; {self.word()}.example.com &middot; ", "Copyright 2020 ", "All rights reserved. ", "") + self.prose(3, 30)
        inside: list[tuple[str, int | None]] = [(text if self.chance(0.6) else f"<p>{text}</p>", 0)]
        if self.chance(0.3):
            inside += [("<ul>", None), *self.links(3), ("</ul>", None)]
        return [("<footer>", None), *inside, ("</footer>", None)] if self.chance(0.75) else [('<div class="footer">', None), *inside, ("</div>", None)]

    def columns(self) -> list[tuple[str, int | None]]:
        """An article between other cells of a layout table, with telling classes or without."""
        telling = self.chance(0.5)
        cell = lambda classes, inside: self.wrapped("td", classes if telling else (), inside)
        out: list[tuple[str, int | None]] = [("<table>", None), ("<tr>", None)]
        if self.chance(0.8):
            out += cell(("menu", "nav", "left"), [("<ul>", None), *self.links(self.rng.integers(2, 9)), ("</ul>", None)] if self.chance(0.7) else self.links(self.rng.integers(2, 9)))
        out += cell(("content", "article-body", "main", "text", "story"), self.article())
        if self.chance(0.4):
            out += cell(("sidebar", "right", "related"), self.side() if self.chance(0.5) else self.links(self.rng.integers(1, 7), 8))
        return [*out, ("</tr>", None), ("</table>", None)]

    def page(self) -> tuple[str, list[int]]:
        """A page, and whether each of its blocks is main text."""
        parts: list[tuple[str, int | None]] = [(f"<!DOCTYPE html><html><head><title>{self.words(2, 10)}</title>", 0), ("<style>p{margin:0}</style></head><body>", None)]
        for p, make in ((0.4, self.head), (0.75, self.menu), (0.25, self.notice), (0.5, self.advert), (0.2, self.side), (0.1, self.form)):
            if self.chance(p):
                parts += make()
        name, classes = self.some(("article", ()), ("article", ()), ("main", ()), ("article", ("post", "entry")), ("div", ("content", "article-body", "post", "entry", "story", "text")), ("section", ("content", "story")), ("div", ()))
        if self.chance(0.2):
            parts += self.columns()
        else:
            parts += self.wrapped(name, classes, self.article())
        for p, make in ((0.3, self.comments), (0.25, self.side), (0.15, self.form), (0.2, self.advert), (0.85, self.foot)):
            if self.chance(p):
                parts += make()
        return "".join(x for x, _ in parts) + "</body></html>", [y for _, y in parts if y is not None]


@cache
def production_labeller() -> Labeller:
    """Learned once per process from TRAIN_PAGES made-up pages."""
    maker, pages, labels = PageMaker(), [], []
    while len(pages) < TRAIN_PAGES:
        html, label = maker.page()
        found = blocks(html)
        if len(found) == len(label):
            pages.append(vectors(found))
            labels.append(np.array(label, np.float32))
    return Labeller().train(pages, labels)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page: the blocks labelled as main text, in page order, joined by blank lines.

    Null and empty html, and pages of which no block is main text, have an empty text. Whole pages
    are read: nothing is cut off or capped. The contents of script and style elements, and of closed
    template, noscript, iframe and svg elements, are no text. Repeated rows are treated alike; an
    empty table gives no rows; only page_id, url and html are read. One narrow pass without a shuffle,
    in time in proportion to a page's length.
    """
    model = production_labeller()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 256):
                found = [blocks(x) if isinstance(x, str) else [] for x in batch[at : at + 256]]
                kept = model.label(found)
                out += ["\n\n".join(b.text for b, ok in zip(page, good) if ok) for page, good in zip(found, kept)]
            yield pd.Series(out)

    texts = pages.select("page_id", "url", extract("html").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
