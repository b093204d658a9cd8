"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element of a page is a node with a hidden state, content or boilerplate. A node's potential comes from features
of the element (tag, hint words in its class, id and role, length, link density and punctuation of its text); a
parent and child share a potential that depends on how strongly the child's tag opens a region of its own. One pass
of messages from the leaves to the root and one back give every node its exact marginal; the text of blocks whose
marginal reaches one half is the page's text.

Trained from labelled pages: those of the table that mark their article (``article`` or ``main``) are labelled by it,
everything outside and every navigation, form, aside or comment inside is boilerplate; SEED_PAGES label kinds of
boilerplate that a table may lack. Unary weights are a logistic regression on the labelled nodes, pair potentials are
counts of their parent-child states.

Results by definition: a null or empty page, and one without content, has an empty text. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined by one space in page order.
Unclosed and stray tags are tolerated. Pages are read whole. Without a labelled page SEED_PAGES alone are learned.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>",
    re.DOTALL,
)
# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = frozenset("li dt dd tr td th option thead tbody tfoot".split())
LISTS = frozenset("ul ol dl table".split())
REGIONS = frozenset("html body div section".split())
TAGS = (
    "article main section div p h1 h2 h3 h4 blockquote pre ul ol li table td th figure figcaption nav header footer aside form button dialog menu dl a b html body address details"
).split()
HINTS = (
    "ad ads advert advertisement sponsor promo banner nav menu breadcrumb sidebar widget related recommend footer header masthead cookie consent notice alert popup modal overlay newsletter "
    "subscribe signup login form search comment comments reply disqus discussion respond share social copyright legal pagination tag tags meta byline author"
).split()
GOOD_HINTS = "article content post entry story body text main".split()
BOILERPLATE = frozenset("nav header footer aside form button dialog menu".split())
_TAG = {t: i for i, t in enumerate(TAGS)}
_WIDTH = len(TAGS) + 1 + 10
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Settings:
    """At most ``rows`` pages of ``bytes`` bytes are learned from."""

    rows: int = 800
    bytes: int = 4_000_000
    steps: int = 25
    ridge: float = 1.0


class Page:
    """Elements in page order (parent before child) and the pieces of text with the block element of each."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.attributes: list[str] = [""]
        self.parents: list[int] = [-1]
        self.pieces: list[tuple[int, str]] = []
        self.blocks: list[int] = [0]
        # Open elements; of these how many there are of each name, and where those stand that end a search for others.
        self._stack = [0]
        self._open: Counter[str] = Counter()
        self._solid: list[int] = []
        self._listed: list[int] = []
        self._endless: set[str] = set()
        self._read(source)

    def _read(self, source: str) -> None:
        at, stack = 0, self._stack
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self._text(" ")
                if name == "hr":
                    self._break_paragraph()
                continue
            if name in RAW and name in self._endless:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at) if name != "head" else re.compile(r"</head\s*>|<body\b", re.IGNORECASE).search(source, at)
                if not end:
                    self._endless.add(name)
                if end or name in ("script", "style"):
                    at = (end.end() if end[0][1] == "/" else end.start()) if end else len(source)
                continue
            if name in CLOSES_P:
                self._break_paragraph()
            if name in SAME_CLOSES:
                self._close_same(name)
            self._push(name, m[3] or m[6] or "")
        if at < len(source):
            self._text(source[at:])

    def _text(self, raw: str) -> None:
        self.pieces.append((self._stack[-1], raw))

    def _push(self, name: str, attributes: str) -> None:
        node, parent = len(self.tags), self._stack[-1]
        self.parents.append(parent)
        self.tags.append(name)
        self.attributes.append(attributes)
        self.blocks.append(self.blocks[parent] if name in INLINE else node)
        if name not in INLINE:
            self._solid.append(len(self._stack))
        if name in SAME_CLOSES or name in LISTS:
            self._listed.append(len(self._stack))
        self._open[name] += 1
        self._stack.append(node)

    def _close_from(self, place: int) -> None:
        for node in self._stack[place:]:
            self._open[self.tags[node]] -= 1
        del self._stack[place:]
        for places in (self._solid, self._listed):
            while places and places[-1] >= place:
                places.pop()

    def _break_paragraph(self) -> None:
        if self._solid and self.tags[self._stack[self._solid[-1]]] == "p":
            self._close_from(self._solid[-1])

    def _close_same(self, name: str) -> None:
        for place in reversed(self._listed):
            tag = self.tags[self._stack[place]]
            if tag == name or name in ("dt", "dd") and tag in ("dt", "dd") or name in ("td", "th") and tag in ("td", "th"):
                self._close_from(place)
                return
            if tag in LISTS or tag == "tr":
                return

    def _close(self, name: str) -> None:
        if self._open[name]:
            place = next(k for k in range(len(self._stack) - 1, 0, -1) if self.tags[self._stack[k]] == name)
            self._close_from(place)

    def block_of(self, node: int) -> int:
        return self.blocks[node]


def features(page: Page) -> np.ndarray:
    """One row for each element; text counts are of the element's whole subtree."""
    n = len(page.tags)
    out = np.zeros((n, _WIDTH))
    chars, linked, stops = [0] * n, [0] * n, [0] * n
    link = [t == "a" for t in page.tags]
    for i in range(1, n):
        link[i] = link[i] or link[page.parents[i]]
    for node, raw in page.pieces:
        size = len(raw.strip())
        chars[node] += size
        if link[node]:
            linked[node] += size
        stops[node] += raw.count(".") + raw.count(",")
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    base = len(TAGS)
    for i in range(n):
        out[i, _TAG.get(page.tags[i], base)] = 1
        words = set(_WORD.findall(page.attributes[i].lower())) if page.attributes[i] and page.tags[i] != "a" else ()
        size = chars[i]
        out[i, base + 1 :] = (
            1, bool(words) and not words.isdisjoint(HINTS), bool(words) and not words.isdisjoint(GOOD_HINTS),
            size > 0, size > 80, min(np.log1p(size), 9) / 9, linked[i] / size if size else 0, size > 0 and linked[i] > size / 2,
            min(stops[i] / size * 20, 1) if size else 0, page.tags[i] in BOILERPLATE,
        )
    return out


def true_states(page: Page) -> np.ndarray | None:
    """The states of a page that marks its article: 1 inside ``article`` or ``main``; None for other pages."""
    state = np.zeros(len(page.tags), np.int8)
    if not any(t in ("article", "main") for t in page.tags):
        return None
    for i in range(1, len(state)):
        tag, words = page.tags[i], set(_WORD.findall(page.attributes[i].lower()))
        # An opening header of an article holds its title; other such parts inside it are not content.
        hidden = tag in BOILERPLATE - {"header"} or (tag not in INLINE and not words.isdisjoint(HINTS))
        state[i] = (tag in ("article", "main") or state[page.parents[i]]) and not hidden
    return state


def _opens(page: Page) -> np.ndarray:
    """For each element the kind of its bond with its parent: 0 inline or text block, 1 container."""
    return np.array([int(t in REGIONS or t in BOILERPLATE or t in ("article", "main")) for t in page.tags])


@dataclass
class Model:
    weights: np.ndarray
    bonds: np.ndarray


def marginals(pages: list[Page], model: Model) -> list[np.ndarray]:
    """The probability of content of every element of every page, by messages up and down all trees at once."""
    sizes = [len(p.tags) for p in pages]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    parent = np.concatenate([np.array(p.parents) + s for p, s in zip(pages, starts, strict=False)])
    parent[starts[:-1]] = -1
    kind = np.concatenate([_opens(p) for p in pages])
    odds = np.clip(np.concatenate([features(p) for p in pages]) @ model.weights, -20, 20)
    depth = np.zeros(len(parent), np.int64)
    for s, p in zip(starts, pages, strict=False):
        own = [0] * len(p.tags)
        for i in range(1, len(own)):
            own[i] = own[p.parents[i]] + 1
        depth[s : s + len(own)] = own
    unary = np.stack([np.zeros(len(odds)), odds], axis=1)
    logsum = np.logaddexp
    bonds = np.log(model.bonds)  # [kind, parent state, child state]
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    up, inward = np.zeros_like(unary), unary.copy()
    for at in reversed(levels[1:]):
        b = bonds[kind[at]]
        up[at] = logsum(b[:, :, 0] + inward[at, None, 0], b[:, :, 1] + inward[at, None, 1])
        np.add.at(inward, parent[at], up[at])
    full = inward.copy()
    for at in levels[1:]:
        b = bonds[kind[at]]
        rest = full[parent[at]] - up[at]
        full[at] += logsum(b[:, 0, :] + rest[:, 0, None], b[:, 1, :] + rest[:, 1, None])
    p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50)))
    return [p[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def main_text(page: Page, content: np.ndarray) -> str:
    blocks, held, current = [], [], None
    for node, raw in page.pieces:
        block = page.block_of(node)
        if content[node] < 0.5 or content[block] < 0.5:
            continue
        if block != current and held:
            blocks.append("".join(held))
            held = []
        current = block
        held.append(raw)
    blocks.append("".join(held))
    # Replacement by white space keeps words apart; references are decoded before white space is folded.
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


# The seed pages count as often as this, beside hundreds of pages of a table.
SEED_WEIGHT = 8
SEED_PAGES = tuple(
    f"<html><body>{before}<article><h1>Title of the page</h1><p>{'A sentence of the text, and more of it. ' * n}</p>{inside}<p>{'The text goes on, as it did before. ' * n}</p></article>{after}</body></html>"
    for n in (1, 3, 8)
    for before, inside, after in (
        ("<header><a href=''>Home</a> Site name</header><nav><ul><li><a href=''>One</a></li><li><a href=''>Two</a></li></ul></nav>", "", "<footer>Copyright, all rights reserved.</footer>"),
        ("<div class='cookie-notice'>We use cookies, read more. <button>Accept</button></div><div class='menu'><a href=''>One</a> <a href=''>Two</a></div>", "<div class='ad'>Buy this now, it is cheap.</div>", "<div id='comments'><p>I agree with this, thanks.</p><p>Nice text, and well told.</p></div>"),
        ("<div class='banner'><p>Big sale today, up to half price.</p></div>", "<aside><p>Read also the other text, it is good.</p></aside><blockquote>A quotation of somebody, quite long.</blockquote>", "<aside class='sidebar'><h3>Related</h3><ul><li><a href=''>Some other text</a></li></ul></aside>"),
        ("<form><label>Search</label><input><button>Go</button></form>", "<form><p>Sign up for news, every day.</p><input></form><ul><li>A point of the text.</li><li>Another point, longer.</li></ul>", "<section class='comments'><h2>Comments</h2><div class='comment'><p>First, and not the last.</p></div></section>"),
        ("<div role='alert' class='notice'>This page is old, see the new one.</div>", "<div class='share'><a href=''>Share</a></div><h2>Part of the text</h2><table><tr><td>A cell of it</td></tr></table>", "<div class='newsletter'><p>Get our letter, each week.</p></div>"),
    )
)


def train(sources: list[str], settings: Settings = Settings()) -> Model:
    rows, states, pairs = [], [], np.ones((2, 2, 2))
    pairs[0] += np.eye(2) * 4
    for source in [*sources, *SEED_PAGES * SEED_WEIGHT]:
        page = Page(source)
        state = true_states(page)
        if state is None:
            continue
        rows.append(features(page)[1:])
        states.append(state[1:])
        np.add.at(pairs, (_opens(page)[1:], state[np.array(page.parents[1:])], state[1:]), 1)
    x, y = np.concatenate(rows), np.concatenate(states).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(settings.steps):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + settings.ridge * np.eye(len(w)), x.T @ (y - p) - settings.ridge * w)
        w += np.clip(step, -2, 2)
    # The bond is the pair's share over what independent states would have: the unary weights hold the rest.
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    return Model(w, joint / (joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)))


def learn(pages: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from a bounded sample of the pages that mark their article, and SEED_PAGES."""
    marked = pages.where(F.coalesce(F.col("html").rlike(r"(?i)<(article|main)[\s>]"), F.lit(False))).select(F.xxhash64("html").alias("_key"), "html")
    sample = common.bounded_sample(marked, F.lit(1), "_key", F.octet_length("html"), settings.rows, settings.bytes)
    return train(sorted(r["html"] for r in sample.select("html").collect()), settings)


def extract(pages: DataFrame, model: Model, column: str = "_main_text") -> DataFrame:
    """``pages`` with the main text of ``html``; other columns are carried unchanged."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def extracted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sources in columns:
            out: list[str] = []
            for low in range(0, len(sources), 200):
                parsed = [Page(x.as_py() or "") for x in sources[low : low + 200]]
                out += [main_text(p, m) for p, m in zip(parsed, marginals(parsed, shared.value), strict=True)]
            yield pa.array(out, pa.string())

    return pages.withColumn(column, extracted(F.col("html")))
