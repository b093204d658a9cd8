"""Secret scans: formats learned by grammar inference, besides fixed patterns.

Patterns give the base spans: assignments of a credential, access keys and long hexadecimal runs. From a bounded
sample of the values they find, each kind's format is inferred: a prefix tree of character classes, whose states are
merged where a Hoeffding bound cannot tell their outgoing frequencies apart, becomes a probabilistic automaton. The
same is learned from ordinary long tokens. Every token of ``shortest`` or more credential characters is then scored
by its likelihood under each format against the ordinary automaton; what exceeds ``margin`` bits a character and is
not inside a base span is reported as ``format``.

Results by definition: spans are in code points, the end exclusive. A null text counts as empty and has no spans. If
no pattern matches anywhere, no format is learned and only base spans are reported. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common

# Fixed patterns of the base spans, with the least length of their value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "format")
# What a text must hold, in lower case, for the first pattern to match.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+/", b"_-", b".", b"=")):
    _CLASS[list(_set)] = _i + 1
SYMBOLS = 10
# How many characters of each class: a class's share is spread evenly over them.
_SIZES = np.array([1, 10, 6, 20, 6, 20, 2, 2, 1, 1])


@dataclass(frozen=True)
class Settings:
    """At most ``rows`` documents of ``bytes`` bytes are read for values; a tree holds at most ``depth`` characters of each."""

    rows: int = 2000
    bytes: int = 4_000_000
    depth: int = 64
    alpha: float = 0.01
    shortest: int = 16
    margin: float = 0.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches whose value is long enough, leftmost and apart within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# A run of at least 24 is found where, and only where, the maximal run is that long.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


class Automaton:
    """A probabilistic automaton over character classes: next state and bits by (state, class), bits to stop by state."""

    def __init__(self, words: list[bytes], settings: Settings):
        children: list[dict[int, int]] = [{}]
        through, stops, seen = [0], [0], [{}]
        for w in words:
            at = 0
            through[0] += 1
            for c in _CLASS[np.frombuffer(w[: settings.depth], np.uint8)].tolist():
                seen[at][c] = seen[at].get(c, 0) + 1
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    through.append(0)
                    stops.append(0)
                    seen.append({})
                at = children[at][c]
                through[at] += 1
            stops[at] += len(w) <= settings.depth  # a cut is no end
        self._merge(children, through, stops, seen, settings.alpha)

    def _merge(self, children, through, stops, seen, alpha) -> None:
        """Red-blue merging: a frontier state joins the first accepted state that it is compatible with, or is accepted."""
        slack = np.sqrt(0.5 * np.log(2 / alpha))

        def apart(a: int, na: int, b: int, nb: int) -> bool:
            return abs(a / na - b / nb) > slack * (na**-0.5 + nb**-0.5)

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                if not through[x] or not through[y]:
                    continue
                if apart(stops[x], through[x], stops[y], through[y]):
                    return False
                for c in seen[x].keys() | seen[y].keys():
                    if apart(seen[x].get(c, 0), through[x], seen[y].get(c, 0), through[y]):
                        return False
                    if c in children[x] and c in children[y] and (children[x][c], children[y][c]) != (x, y):
                        todo.append((children[x][c], children[y][c]))
            return True

        def fold(a: int, b: int) -> None:
            """Adds the tree below b to state a."""
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                through[x] += through[y]
                stops[x] += stops[y]
                for c, n in seen[y].items():
                    seen[x][c] = seen[x].get(c, 0) + n
                    if c in children[x]:
                        todo.append((children[x][c], children[y][c]))
                    else:
                        children[x][c] = children[y][c]

        red, blue = [0], [(0, c) for c in sorted(children[0])]
        accepted = {0}
        while blue:
            blue.sort(key=lambda pc: (-through[children[pc[0]][pc[1]]], pc))
            parent, c = blue.pop(0)
            state = children[parent][c]
            if state in accepted:
                continue
            for r in red:
                if compatible(r, state):
                    children[parent][c] = r
                    fold(r, state)
                    break
            else:
                red.append(state)
                accepted.add(state)
            blue = [(r, s) for r in red for s in children[r] if children[r][s] not in accepted]
        place = {r: i for i, r in enumerate(red)}
        self.next = np.zeros((len(red) + 1, SYMBOLS), np.int32) + len(red)
        self.bits = np.full((len(red) + 1, SYMBOLS), 16.0)
        self.stop = np.full(len(red) + 1, 16.0)
        for r, i in place.items():
            total = through[r] + 1.0
            for c, n in seen[r].items():
                self.next[i, c] = place[children[r][c]]
                self.bits[i, c] = -np.log2(n / total / _SIZES[c])
            self.stop[i] = -np.log2((stops[r] + 0.5) / total)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word: its classes' and its end's."""
        longest = max(map(len, words), default=0)
        grid = np.zeros((len(words), longest), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        for i, w in enumerate(words):
            grid[i, : len(w)] = _CLASS[np.frombuffer(w, np.uint8)]
        state, out = np.zeros(len(words), np.int64), np.zeros(len(words))
        for t in range(longest):
            live = sizes > t
            out[live] += self.bits[state[live], grid[live, t]]
            state[live] = self.next[state[live], grid[live, t]]
        return out + self.stop[state]


def _value(text: str, start: int, end: int, kind: str) -> bytes:
    piece = text[start:end]
    return (ASSIGN.match(piece)[2] if kind == "assign" else piece).encode()


@dataclass
class Model:
    formats: list[Automaton]
    ordinary: Automaton
    settings: Settings

    def extra(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        spans, words = [], []
        for start, end in _candidates(text, self.settings.shortest):
            if all(end <= a or start >= b for a, b, _ in base):
                spans.append((start, end, "format"))
                words.append(text[start:end].encode())
        if not words:
            return []
        best = np.min([f.score(words) for f in self.formats], axis=0)
        gain = (self.ordinary.score(words) - best) / np.array([len(w) for w in words])
        return [s for s, g in zip(spans, gain.tolist(), strict=True) if g >= self.settings.margin]


def _candidates(text: str, shortest: int) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % shortest, text)]


def train(texts: list[str], settings: Settings = Settings()) -> Model | None:
    """Formats from the base spans of whole texts; ordinary tokens from the rest of the same texts."""
    values: dict[str, list[bytes]] = {k: [] for k in KINDS[:3]}
    ordinary: list[bytes] = []
    for text in texts:
        base = base_spans(text)
        for start, end, kind in base:
            values[kind].append(_value(text, start, end, kind))
        for start, end in ((m.start(), m.end()) for m in TOKEN.finditer(text)):
            if end - start >= 8 and all(end <= a or start >= b for a, b, _ in base):
                ordinary.append(text[start:end].encode())
    formats = [Automaton(sorted(set(v)), settings) for v in values.values() if v]
    return Model(formats, Automaton(sorted(ordinary), settings), settings) if formats and ordinary else None


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from a bounded sample of the documents that a base pattern may match."""
    low = F.lower("text")
    likely = F.lit(False)
    for w in WORDS:
        likely = likely | F.contains(low, F.lit(w))
    likely = likely | F.contains("text", F.lit("AKIA"))
    usable = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("_likely", likely)
    # Documents with a likely credential and others are sampled alike, so that ordinary tokens are seen as well.
    sample = common.bounded_sample(usable, F.col("_likely"), "doc_id", F.octet_length("text"), settings.rows, settings.bytes)
    return train([r["text"] for r in sample.select("doc_id", "text").orderBy("doc_id", "text").collect()], settings)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: Model | None, column: str = "_secrets") -> DataFrame:
    """``docs`` with a struct column: counts by kind, the digest of the base spans and all spans."""
    kind = "struct<n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def scanned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learned = shared.value
        for texts in columns:
            rows = []
            for text in (x.as_py() or "" for x in texts):
                base = base_spans(text)
                extra = learned.extra(text, base) if learned else []
                count = [sum(k == s[2] for s in base) for k in KINDS[:3]]
                both = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((*count, len(extra), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both)))
            parts = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.StructArray.from_arrays(
                [pa.array(list(p), pa.int64() if i < 4 else pa.string()) for i, p in enumerate(parts)], ["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]
            )

    return docs.withColumn(column, scanned(F.col("text")))
