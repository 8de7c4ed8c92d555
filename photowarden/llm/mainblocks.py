"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the path of open elements above it. A block's
vector is made of its hashed tag-path tokens (element names and the words of their classes, ids and roles), its hashed
words and a few counts; a bidirectional LSTM in numpy reads a page's blocks forwards and backwards and says for each
whether it is main text, so a block is judged in the context of the whole page.

There are no labelled pages, so the labeller is trained on pages from a generator below that knows which blocks are the
article's: page skeletons of many kinds with menus, headers, footers, sidebars, notices, adverts, forms and comments
under usual and unusual names, in random pseudo-words, so that layout and not vocabulary decides.

A page is read in one pass of linear time, whatever it holds. Scripts and other raw elements end at their literal end
tag, whatever stands between. A quote after an equals sign runs to the next such quote; from the first tag on that so
would never end, tags end at the next ">".

Defined results: null or empty html, and a page without main blocks, has empty text and no characters; scripts, styles,
form controls and head matter are never text; unclosed tags end where an enclosing element or the page does; a raw
element without its end tag runs to the end of the page; very long pages are read whole, every block, word and name
counts; blocks with equal vectors and surroundings have equal labels; repeated rows have equal results; an empty table
gives no rows; extra columns are carried along unless they are named text, n_chars or n_blocks, which are replaced.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 96, 24, 10, 20
INPUTS = PATH_DIM + WORD_DIM + NUMBERS
PAGES, EPOCHS, BATCH, RATE, SEED = 960, 6, 32, 0.01, 11
#: Blocks that are labelled at once.
AT_ONCE = 4096

#: A start tag; a quoted value may hold ">". Nothing is tried twice.
_START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Elements whose content is never text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button option datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Where elements of another language begin.
FOREIGN = ("svg", "math")
# Elements inside a line of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
# A start tag of the key ends an open element of the value first.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "p": ("p",), "body": ("head", "title"),
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_HOLDERS = frozenset("ul ol dl table div section article main body nav aside header footer form".split())


_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    """An element under its ancestors: its names and, once asked for, the vector of the path down to it."""

    __slots__ = ("_below", "_sums", "_vector", "depth", "names", "parent")

    def __init__(self, names: tuple[str, ...] = (), parent: Node | None = None):
        self.names, self.parent = names, parent
        self.depth = parent.depth + 1 if parent else 0
        self._below: dict[tuple[str, ...], Node] = {}
        self._sums: np.ndarray | None = None
        self._vector: np.ndarray | None = None

    def child(self, names: tuple[str, ...]) -> Node:
        """The same node for the same names: pages of one layout share their paths."""
        got = self._below.get(names)
        if got is None:
            got = self._below[names] = Node(names, self)
            _made[0] += 1
        return got

    def sums(self) -> np.ndarray:
        """Counts of the path's hashed names; each element adds its own to those of the one above, once."""
        missing: list[Node] = []
        node: Node | None = self
        while node is not None and node._sums is None:
            missing.append(node)
            node = node.parent
        above = node._sums if node is not None else np.zeros(PATH_DIM, np.float32)
        for node in reversed(missing):
            node._sums = above.copy()
            for k, name in enumerate(node.names):
                node._sums[_hash(("#" if k else "<") + name, PATH_DIM)] += 1.0
            above = node._sums
        return above

    def vector(self) -> np.ndarray:
        if self._vector is None:
            got = self.sums().copy()
            for name in self.names:
                got[_hash("leaf " + name, PATH_DIM)] += 0.5
            self._vector = np.minimum(got, 2, out=got)
        return self._vector


#: The root of the paths, which is made anew after so many nodes.
_root, _made, _MOST_NODES = [Node()], [0], 20_000


@dataclass
class Block:
    text: str
    path: Node
    link_chars: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    if attributes and "=" in attributes:
        for m in _ATTR.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            found += [w for w in _SPLIT.split(_CAMEL.sub("-", value).lower()) if w and not w.isdigit()]
    return tuple(found)


def tokens(page: str):
    """(kind, name, attributes or text) in order: text, start and end; comments and the content of raw elements are left out."""
    at, n, plain_tags, foreign = 0, len(page), False, ""
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        follows = page[lt + 1 : lt + 2]
        if follows == "!" or follows == "?":
            if page.startswith("<!--", lt):
                end, width = page.find("-->", lt + 2), 3  # "<!-->" is a whole comment
            elif page.startswith("<![CDATA[", lt):
                end, width = page.find("]]>", lt), 3
                if end >= 0:
                    yield "text", "", page[lt + 9 : end].replace("&", "&amp;")
            else:
                end, width = page.find(">", lt), 1
            if end < 0:
                return
            at = end + width
        elif follows == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            if end < 0:
                return
            tag = _NAME.match(page, lt + 2)[0].lower()
            yield "end", tag, ""
            at, foreign = end + 1, "" if tag == foreign else foreign
        elif follows.isascii() and follows.isalpha():
            m = None if plain_tags else _START.match(page, lt)
            if m is not None:
                tag, attributes, at = m[1].lower(), m[2], m.end()
            else:
                plain_tags, end = True, page.find(">", lt)
                if end < 0:
                    return
                name = _NAME.match(page, lt + 1)
                tag, attributes, at = name[0].lower(), page[name.end() : end], end + 1
            yield "start", tag, attributes
            if tag in FOREIGN and not foreign and not attributes.endswith("/"):
                foreign = tag
            if tag in RAW and not foreign:
                closing = _RAW_ENDS[tag].search(page, at)
                if closing is None:
                    return
                at = closing.start()
        elif follows == "/":  # an end tag without a name is a comment
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "", "<"
            at = lt + 1


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, Node]] = []
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    holders: list[int] = []
    text: list[str] = []
    links = in_link = dropped = 0
    if _made[0] > _MOST_NODES:
        _root[0], _made[0] = Node(), 0
    root = _root[0]

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append(Block(joined, stack[-1][1] if stack else root, min(links, len(joined))))
            text.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal dropped
        flush()
        for tag, _ in reversed(stack[k:]):
            dropped -= tag in DROPPED
            opened[tag].pop()
            if tag in _HOLDERS:
                holders.pop()
        del stack[k:]

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if not dropped:
                text.append(htmllib.unescape(rest))  # a reference ends where its text does
                if in_link:
                    links += len(rest.strip())
        elif kind == "end":
            if tag in INLINE:
                in_link = 0 if tag == "a" else in_link
            elif tag == "br" or not opened.get(tag):
                flush()
            else:
                pop_to(opened[tag][-1])
        elif tag in INLINE:
            in_link = 1 if tag == "a" else in_link
        else:
            flush()
            in_link = 0
            if tag in VOID:
                continue
            ends = CLOSES.get(tag, ())
            if tag in _ENDS_P:
                ends = (*ends, "p")
            nearest = max((opened[e][-1] for e in ends if opened.get(e)), default=-1)
            if nearest > (holders[-1] if holders and tag != "body" else -1):
                pop_to(nearest)
            if rest.endswith("/") and (tag in FOREIGN or any(opened.get(f) for f in FOREIGN)):
                continue  # a slash closes void and foreign elements only
            opened.setdefault(tag, []).append(len(stack))
            if tag in _HOLDERS:
                holders.append(len(stack))
            stack.append((tag, (stack[-1][1] if stack else root).child(_names(tag, rest))))
            dropped += tag in DROPPED
    flush()
    return blocks


@lru_cache(1 << 16)
def _hash(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


def page_vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for k, b in enumerate(blocks):
        row = out[k]
        row[:PATH_DIM] = b.path.vector()
        words = b.text.split(" ")
        for w, n in Counter(map(str.lower, words)).items():
            row[PATH_DIM + _hash(w, WORD_DIM)] += n
        leaf = b.path.names[0] if b.path.names else ""
        row[-NUMBERS:] = (
            np.log1p(len(b.text)) / 6, np.log1p(len(words)) / 5, b.link_chars / max(1, len(b.text)), leaf == "p", leaf in ("h1", "h2", "h3", "h4"), leaf == "li",
            sum(b.text.count(c) for c in ".,;!?") / (1 + len(words)), b.path.depth / 10, k / max(1, len(blocks) - 1), b.text[-1:] in ".!?",
        )
    words = out[:, PATH_DIM : PATH_DIM + WORD_DIM]
    np.minimum(np.log1p(words) / 2, 1, out=words)
    return out


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output; both directions run side by side."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        s = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.wx, self.wh, self.b = s(2, INPUTS, 4 * HIDDEN), s(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 1, 4 * HIDDEN), np.float32)
        self.b[:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.out, self.skip, self.bias = s(2 * HIDDEN, 1), s(INPUTS, 1) * 0, np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.out, self.skip, self.bias]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (pages, steps, inputs), mask: which steps are blocks. Logits (pages, steps)."""
        n, steps, _ = x.shape
        both = np.stack([x, x[:, ::-1]])  # padding comes first in the backward direction: it leaves the state at zero
        m = np.stack([mask, mask[:, ::-1]])[..., None].astype(np.float32)
        pre = (both.reshape(2, n * steps, -1) @ self.wx + self.b).reshape(2, n, steps, -1)
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hs, tape = np.empty((2, n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[:, :, t] + h @ self.wh
            gates = 1 / (1 + np.exp(-np.clip(z[..., : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            g = np.tanh(z[..., 3 * HIDDEN :])
            before, h_before = c, h
            c = (f * c + i * g) * m[:, :, t]
            tc = np.tanh(c)
            h = o * tc
            hs[:, :, t] = h
            if keep:
                tape.append((i, f, o, g, before, tc, h_before))
        joined = np.concatenate([hs[0], hs[1][:, ::-1]], -1)
        logits = (joined @ self.out + x @ self.skip + self.bias)[..., 0]
        return (logits, (both, m, tape, joined)) if keep else logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        logits, (both, m, tape, joined) = self.forward(x, mask, keep=True)
        d = ((1 / (1 + np.exp(-logits)) - y) * mask / mask.sum()).astype(np.float32)[..., None]
        n, steps, _ = x.shape
        flat = d.reshape(-1, 1)
        d_out, d_skip, d_bias = joined.reshape(-1, 2 * HIDDEN).T @ flat, x.reshape(-1, INPUTS).T @ flat, flat.sum(0)
        dj = d @ self.out.T
        dhs = np.stack([dj[..., :HIDDEN], dj[..., HIDDEN:][:, ::-1]])
        d_pre = np.empty((2, n, steps, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        d_wh = np.zeros_like(self.wh)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, h_before = tape[t]
            dh = dh + dhs[:, :, t]
            dc = (dc + dh * o * (1 - tc * tc)) * m[:, :, t]
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
            d_pre[:, :, t] = dz
            d_wh += h_before.transpose(0, 2, 1) @ dz
            dh, dc = dz @ self.wh.transpose(0, 2, 1), dc * f
        flat = d_pre.reshape(2, n * steps, -1)
        return [both.reshape(2, n * steps, -1).transpose(0, 2, 1) @ flat, d_wh, flat.sum(1, keepdims=True), d_out, d_skip, d_bias]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and (end == at or (end - at + 1) * len(pages[order[end]]) <= AT_ONCE):
                end += 1
            some = order[at:end]
            x, mask = padded([pages[k] for k in some])
            logits = self.forward(x, mask)
            for row, k in enumerate(some):
                out[k] = logits[row, : len(pages[k])] > 0
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, INPUTS), np.float32), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


# ---- training pages ------------------------------------------------------------------------------------------------

# Names of page parts, for the generator.
ARTICLE_NAMES = "article article-body post post-content entry entry-content content main-content story story-body text body-text page-content".split()
JUNK_NAMES = {
    "nav": "nav menu navbar main-menu breadcrumb breadcrumbs pagination toc tabs site-nav".split(),
    "header": "header site-header masthead banner top-bar branding logo".split(),
    "footer": "footer site-footer copyright bottom legal colophon credits".split(),
    "aside": "sidebar aside side related related-posts widget recommended popular trending promo newsletter".split(),
    "ad": "ad ads advert advertisement sponsor sponsored ad-slot banner-ad promo-box".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay subscribe paywall warning".split(),
    "form": "search login signup subscribe-form contact form-box".split(),
    "comments": "comments comment comment-list reply replies discussion reader-comments disqus responses".split(),
    "share": "share social share-buttons tools tags meta byline-links author-box".split(),
}

DOC_NAMES = "doc docs document documentation doc-content manual guide page article-content markdown-body".split()
DOC_SIDE_NAMES = "sidebar toc contents docs-nav tree side-menu".split()


class PageMaker:
    """Random pages whose main blocks are known."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéèñçß"))
        self.words = ["".join(self.rng.choice(letters, self.rng.integers(1, 9))) for _ in range(3000)]
        self.names = "usual"

    def pick(self, some):
        return some[int(self.rng.integers(len(some)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def phrase(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join(self.words[k] for k in self.rng.integers(0, len(self.words), n)).capitalize()

    def sentences(self, low: int, high: int) -> str:
        parts = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            parts.append(self.phrase(1, 14) + self.pick([".", ".", ".", "!", "?", ".&amp;", ".***"]))
        return " ".join(parts)

    def attributes(self, names: list[str], always: bool) -> str:
        if self.names == "none" or not always and self.chance(0.4):
            return ""
        if self.names == "hashed":  # as build tools make them
            names = ["css-" + self.pick(self.words), self.pick(self.words) + "_" + self.pick(self.words)]
        return f' {self.pick(["class", "class", "id"])}="{self.pick(names)}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.pick(self.words)}">{self.phrase(low, high)}</a>'

    def paragraph(self) -> str:
        text = self.sentences(1, 6)
        if self.chance(0.15):
            text = self.sentences(1, 1) if self.chance(0.5) else self.phrase(1, 4)
        if self.chance(0.15):
            text += " " + self.link() + " " + self.phrase(1, 5) + "."
        return text

    def main(self) -> str:
        out = []
        head = self.phrase(2, 9) + self.pick(["", ".", "&amp;"])
        if self.chance(0.85):
            out.append(f"<h1>{head}</h1>")
        if self.chance(0.5):
            out.append(f"<p><b>{head}<br>" if self.chance(0.6) else f"<p><em>{head}</em></p>")
        for _ in range(int(self.rng.integers(1, 16))):
            kind = self.rng.random()
            if kind < 0.76:
                out.append(f"<p>{self.paragraph()}" + self.pick(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.84:
                out.append(self.pick(["<h2>%s</h2>", "<h3>%s</h3>", "<p><b>%s<br>"]) % self.phrase(1, 7))
            elif kind < 0.9:
                tag = self.pick(["ul", "ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(int(self.rng.integers(2, 5)))) + f"</{tag}>")
            elif kind < 0.94:
                out.append(f"<blockquote>{self.sentences(1, 3)}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{self.phrase(1, 3)}</td><td>{self.phrase(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<pre>{self.phrase(3, 12)}</pre>")
        return "".join(out)

    def junk(self, kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        own = self.chance(0.7)
        attrs = self.attributes(JUNK_NAMES[kind], always=not own or tag in ("div", "section"))
        tag = tag if own else self.pick(["div", "div", "section", "ul" if kind == "nav" else "div"])
        if kind == "nav" or (kind in ("aside", "share", "footer") and self.chance(0.4)):
            items = "".join(f"<li>{self.link()}</li>" for _ in range(int(self.rng.integers(2, 9))))
            body = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "comments":
            body = "".join(self.pick(["<div class=\"%s\"><p>%s</p></div>", "<p class=\"%s\">%s</p>", "<li class=\"%s\">%s</li>"]) % (self.pick(JUNK_NAMES["comments"]), self.sentences(1, 4)) for _ in range(int(self.rng.integers(1, 6))))
            body = self.pick(["<h2>%s</h2>", "<h3>%s</h3>", ""]).replace("%s", self.phrase(1, 2)) + body
        elif kind == "form":
            body = f"<label>{self.phrase(1, 2)}</label><input type=text> {self.pick(['', '<p>' + self.phrase(2, 8) + '</p>'])}<button>{self.phrase(1, 2)}</button>"
        elif kind == "footer":
            body = self.pick(["&copy; ", "", "2024 "]) + self.pick(self.words) + " &middot; " + self.sentences(1, 2)
            body = body if self.chance(0.5) else f"<p>{body}</p>"
        else:
            body = self.sentences(1, 4)
            body = self.pick(["%s", "<p>%s</p>", "<h3>" + self.phrase(1, 3) + "</h3><p>%s</p>", "<div>%s</div>"]) % body
        return f"<{tag}{attrs}>{body}</{tag}>"

    def link_column(self) -> str:
        links = [self.link() for _ in range(int(self.rng.integers(3, 9)))]
        return self.pick(["<br>", "<br>", " | ", "</p><p>"]).join(links)

    def table_page(self) -> str:
        """The page is a table: a row with the site's name, a column of links beside the text, a row with rights."""
        text = "<p>".join(self.paragraph() for _ in range(int(self.rng.integers(2, 9)))) if self.chance(0.4) else self.main()
        cells = [f"<td>{self.link_column()}</td>", f"<td>\x01{text}\x02</td>"]
        if self.chance(0.3):
            cells.append(f"<td>{self.link_column() if self.chance(0.5) else self.phrase(2, 9)}</td>")
        if self.chance(0.3):
            cells[:2] = cells[1::-1]
        top = f"<tr><td colspan=2>{self.pick(['<img src=l.gif> ', ''])}{self.phrase(1, 4)}</td></tr>" * self.chance(0.85)
        bar = f"<tr><td colspan=2>{' | '.join(self.link(1, 1) for _ in range(4))}</td></tr>" * self.chance(0.4)
        end = f"<tr><td colspan=2>{self.pick(['&copy; ', 'Copyright ', ''])}2003 {self.phrase(1, 6)}</td></tr>" * self.chance(0.85)
        return f"<table{self.attributes(ARTICLE_NAMES[-1:], False)}>{top}{bar}<tr>{''.join(cells)}</tr>{end}</table>"

    def document_page(self) -> str:
        """A manual's page: contents beside it, code and numbered steps in it, then the next page and a question to the reader."""
        contents = "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(int(self.rng.integers(3, 12)))) + "</ul>"
        side = self.pick(["<div%s>%s</div>", "<nav%s>%s</nav>", "<aside%s>%s</aside>"]) % (self.attributes(DOC_SIDE_NAMES, self.chance(0.8)), contents)
        parts = [f"<h1>{self.phrase(1, 5)}</h1>"]
        for _ in range(int(self.rng.integers(2, 9))):
            steps = "".join(f"<li>{self.sentences(1, 1) if self.chance(0.6) else self.phrase(2, 9)}</li>" for _ in range(int(self.rng.integers(2, 6))))
            parts.append(self.pick([f"<p>{self.paragraph()}</p>", f"<p>{self.paragraph()}</p>", f"<pre>{self.phrase(2, 9)}</pre>", f"<pre><code>{self.phrase(2, 9)}</code></pre>", f"<ol>{steps}</ol>", f"<h2>{self.phrase(1, 4)}</h2>", f"<dl><dt>{self.phrase(1, 2)}</dt><dd>{self.sentences(1, 1)}</dd></dl>"]))
        tag = self.pick(["section", "section", "div", "main", "article"])
        body = f"<{tag}{self.attributes(DOC_NAMES, True)}>\x01{''.join(parts)}\x02</{tag}>"
        ask = self.pick(["<form%s><label>%s</label><button>Yes</button></form>", "<form%s><p>%s</p><button>Yes</button></form>", "<div%s>%s</div>"]) % (self.attributes(["feedback", "helpful", "rating", "survey"], False), self.phrase(3, 7) + "?")
        turn = f"<div{self.attributes(['pager', 'prev-next', 'pagination'], False)}>{self.link()} {self.link()}</div>" * self.chance(0.5)
        rest = turn + ask * self.chance(0.7)
        return self.junk("header") * self.chance(0.5) + (side + body + rest if self.chance(0.7) else body + rest + side) + self.junk("footer") * self.chance(0.6)

    def thread_page(self) -> str:
        """A forum: the first post is the text, the replies are comments."""
        post = "".join(f"<p>{self.paragraph()}</p>" for _ in range(int(self.rng.integers(1, 6))))
        first = f"<div{self.attributes(['post', 'topic', 'op', 'first-post', 'question', 'message'], True)}>\x01<h1>{self.phrase(2, 8)}</h1>{post}\x02</div>"
        return self.junk("nav") + first + self.junk("comments") + self.junk("footer") * self.chance(0.7)

    def page(self) -> str:
        """The html with marks around main parts, which are taken out again by `example`."""
        self.names = "none" if self.chance(0.12) else "hashed" if self.chance(0.12) else "usual"
        kind = self.rng.random()
        if kind < 0.3:
            if kind < 0.12 and self.names == "usual":
                self.names = "none"
            body = self.table_page() if kind < 0.12 else self.document_page() if kind < 0.24 else self.thread_page()
            return f"<html><head><title>{self.phrase(2, 6)}</title></head><body>{body}" + self.pick(["</body></html>", ""])
        before = [k for k, p in (("header", 0.35), ("nav", 0.7), ("notice", 0.2), ("ad", 0.5), ("form", 0.15), ("aside", 0.15)) if self.chance(p)]
        after = [k for k, p in (("share", 0.2), ("comments", 0.35), ("aside", 0.35), ("ad", 0.2), ("form", 0.12), ("nav", 0.12), ("notice", 0.12), ("footer", 0.75)) if self.chance(p)]
        main = self.main()
        if self.chance(0.35):  # junk inside the article
            cut = [m.start() for m in re.finditer(r"<p>|<h2>|<h3>", main)] or [0]
            at = self.pick(cut)
            main = main[:at] + "\x02" + self.junk(self.pick(["ad", "share", "aside", "notice", "form"])) + "\x01" + main[at:]
        shape = self.rng.random()
        open_tag = f"<article{self.attributes(ARTICLE_NAMES, False)}>" if shape < 0.55 else f"<main{self.attributes(ARTICLE_NAMES, False)}>" if shape < 0.7 else f"<{self.pick(['div', 'section'])}{self.attributes(ARTICLE_NAMES, True)}>"
        close = "</" + re.match(r"<(\w+)", open_tag)[1] + ">"
        inner = f"{open_tag}\x01{main}\x02"
        if self.chance(0.25):
            inner += self.junk(self.pick(["comments", "share", "aside"]))
        inner += close
        if self.chance(0.3):
            inner = f"<{self.pick(['main', 'div'])}{self.attributes(['wrapper', 'container', 'page', 'layout', 'main'], False)}>{inner}</div>"
        top, bottom = "".join(map(self.junk, before)), "".join(map(self.junk, after))
        head = f"<!DOCTYPE html><html><head><title>{self.phrase(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        return head + top + inner + bottom + self.pick(["</body></html>", ""])

    def example(self) -> tuple[np.ndarray, np.ndarray, list[Block]]:
        """Block vectors and labels of a page."""
        marked = leaf_blocks(re.sub(r"([\x01\x02])", r"<x-mark>\1</x-mark>", self.page()))
        blocks, labels, main = [], [], False
        for b in marked:
            if b.text in ("\x01", "\x02"):
                main = b.text == "\x01"
            else:
                blocks.append(b)
                labels.append(main)
        return page_vectors(blocks), np.array(labels, np.float32), blocks


_trained: dict[int, Labeller] = {}


def trained(seed: int = SEED, pages: int = PAGES) -> Labeller:
    """The labeller, trained on generated pages with Adam; the same every time."""
    if seed in _trained:
        return _trained[seed]
    maker = PageMaker(seed)
    examples = [maker.example() for _ in range(pages)]
    examples = [(x, y) for x, y, _ in examples if len(x)]
    model, rng = Labeller(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step, total = 0, EPOCHS * -(-len(examples) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for a in range(0, len(order), BATCH):
            some = [examples[k] for k in order[a : a + BATCH]]
            x, mask = padded([e[0] for e in some])
            y = np.zeros(mask.shape, np.float32)
            for k, e in enumerate(some):
                y[k, : len(e[1])] = e[1]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, (m, v) in zip(model.parameters(), model.gradients(x, mask, y), moments, strict=True):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    _trained[seed] = model
    return model


def main_text(pages: list[str | None], model: Labeller) -> list[tuple[str, int]]:
    """Main text and number of main blocks of each page."""
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    labels = model.label([page_vectors(b) for b in blocks])
    return [(" ".join(b.text for b, main in zip(some, keep, strict=True) if main), int(keep.sum())) for some, keep in zip(blocks, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, column: str = "html") -> DataFrame:
    """Adds text, n_chars and n_blocks in place of the html column."""
    common.prepare(pages.sparkSession)
    model = model or trained()
    own = [c for c in pages.columns if c not in (column, "text", "n_chars", "n_blocks")]

    def run(batches):
        for batch in common.slices(batches, 64):
            found = main_text(batch.column(len(own)).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                [*own, "text", "n_chars", "n_blocks"],
            )

    rows = pages.select(*(F.col(f"`{c}`") for c in own), F.col(column).cast("string"))
    return rows.mapInArrow(run, "".join(f"`{n}` {k}, " for n, k in rows.dtypes[:-1]) + "text string, n_chars long, n_blocks long")
