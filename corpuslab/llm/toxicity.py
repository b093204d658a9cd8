"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are labelled from documents: a word of a toxic document is toxic if one of its units (the word, or its first
four, five or six bytes) occurs in at least ``least`` sampled documents and the share of toxic ones among those is
``share`` or more above chance; all other words are not. On these label sequences a two-state chain is trained by
gradient steps on the conditional likelihood: weights of hashed units, a bias and transitions. Forward-backward gives every token its
marginal; a document's score is a logistic function of its largest marginal and of the expected number of toxic
tokens, fitted on the sample, and its spans are the tokens whose marginal reaches one half.

Results by definition: null, empty and wordless texts have no spans and the score of a text without toxic tokens.
Labels of ids that several rows share apply to each row; null labels are no labels. If only one class is labelled,
nothing can be learned and the score is 0. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.words import HashIndex, piecewise_hashes, words_of

PREFIXES = (4, 5, 6)
# Chains are walked in blocks of so many tokens, all blocks at once.
BLOCK = 64


@dataclass(frozen=True)
class Settings:
    """At most ``rows`` and ``bytes`` of each class are read for training; units in under ``least`` of them have no weight."""

    rows: int = 2000
    bytes: int = 3_000_000
    least: int = 4
    share: float = 0.5
    epochs: int = 20
    rate: float = 0.5
    decay: float = 1e-4


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each token's word and prefixes, starts, ends, first token of each text)."""
    low, starts, ends, hashes, first = words_of(data, offsets)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = hashes
    for i, n in enumerate(PREFIXES):
        long = ends - starts >= n
        out[long, i + 1] = piecewise_hashes(low, starts[long], starts[long] + n, salt=n)
    return out, starts, ends, first


@dataclass
class Model:
    """Weights of the known units, bias, transitions [from, to] and the two-feature document score."""

    index: HashIndex
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    document: np.ndarray

    def emissions(self, unit: np.ndarray) -> np.ndarray:
        row = self.index.find(unit.ravel()).reshape(unit.shape)
        return self.bias + np.where(row >= 0, self.weights[np.maximum(row, 0)], 0.0).sum(axis=1)

    def score(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_evidence(marginals, first) @ self.document))


def _evidence(marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, log-odds of the largest marginal, log of one plus the expected toxic tokens among likely ones."""
    out = np.zeros((len(first) - 1, 3))
    out[:, 0], out[:, 1] = 1, -12
    full = np.flatnonzero(np.diff(first))
    if len(full):
        top = np.clip(np.maximum.reduceat(marginals, first[full]), 6e-6, 1 - 6e-6)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log1p(np.add.reduceat(np.where(marginals >= 0.5, marginals, 0.0), first[full]))
    return out


def forward_backward(emission: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of the toxic state of each token, expected moves summed over all neighbours), exactly.

    ``emission`` is the log-odds of the toxic state. Long chains are cut into blocks: first the matrix that carries
    a message through each block is multiplied up for all blocks at once, then messages pass from block to block
    within a text, then through the tokens of all blocks at once.
    """
    n, size = len(emission), np.diff(first)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    step = np.exp(moves - moves.max())
    e = np.stack([np.ones(n), np.exp(np.clip(emission, -30, 30))], axis=1)
    blocks = -(-size // BLOCK)
    text = np.repeat(np.arange(len(size)), blocks)
    order = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[text] + order * BLOCK
    length = np.minimum(begin + BLOCK, first[text + 1]) - begin
    start_of_text = order == 0
    # carried[b] maps the message before block b to the one after it (rows: state before, columns: state after).
    carried = np.repeat(np.eye(2)[None], len(text), axis=0)
    for t in range(int(length.max())):
        live = np.flatnonzero(length > t)
        free = live[start_of_text[live]] if t == 0 else live[:0]
        m = step[None] * e[begin[live] + t][:, None, :]
        if len(free):
            m[start_of_text[live]] = np.eye(2) * e[begin[free] + t][:, None, :]
        out = carried[live] @ m
        carried[live] = out / out.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.ones((len(text), 2)) / 2, np.ones((len(text), 2)) / 2
    for k in range(1, int(blocks.max()) if len(blocks) else 0):
        at = np.flatnonzero(order == k)
        v = np.einsum("ni,nij->nj", ahead[at - 1], carried[at - 1])
        ahead[at] = v / v.sum(axis=1, keepdims=True)
    last = np.repeat(blocks, blocks) - 1
    for k in range(int(blocks.max()) - 2 if len(blocks) else -1, -1, -1):
        at = np.flatnonzero((order == k) & (last > k))
        v = np.einsum("nij,nj->ni", carried[at + 1], behind[at + 1])
        behind[at] = v / v.sum(axis=1, keepdims=True)
    forward, backward = np.empty((n, 2)), np.empty((n, 2))
    message = ahead.copy()
    for t in range(int(length.max())):
        live = np.flatnonzero(length > t)
        v = message[live] @ step
        if t == 0:
            v[start_of_text[live]] = message[live][start_of_text[live]]
        v = v * e[begin[live] + t]
        message[live] = forward[begin[live] + t] = v / v.sum(axis=1, keepdims=True)
    message = behind.copy()
    for t in range(int(length.max()) - 1, -1, -1):
        live = np.flatnonzero(length > t)
        here = begin[live] + t
        backward[here] = message[live]
        v = (message[live] * e[here]) @ step.T
        message[live] = v / v.sum(axis=1, keepdims=True)
    both = forward * backward
    marginal = both[:, 1] / both.sum(axis=1)
    inner = np.ones(n, bool)
    inner[first[1:][size > 0] - 1] = False
    i = np.flatnonzero(inner)
    pair = forward[i][:, :, None] * step[None] * (e[i + 1] * backward[i + 1])[:, None, :]
    return marginal, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _known_units(unit: np.ndarray, owner: np.ndarray, toxic: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units in at least ``least`` texts, in how many texts each is, in how many toxic ones)."""
    flat, text = unit.ravel(), np.repeat(owner, unit.shape[1])
    keep = flat != 0
    keys, row = np.unique(flat[keep], return_inverse=True)
    own = np.unique(row.astype(np.int64) * len(toxic) + text[keep])
    seen = np.bincount(own // len(toxic), minlength=len(keys))
    bad = np.bincount(own // len(toxic), weights=toxic[own % len(toxic)], minlength=len(keys))
    kept = seen >= least
    return keys[kept], seen[kept], bad[kept]


def train(texts: list[str], toxic: np.ndarray, settings: Settings = Settings()) -> Model | None:
    """A chain from whole texts and their 0/1 labels."""
    if len(texts) == 0 or toxic.min() == toxic.max():
        return None
    parts = [units(d, o) for _, _, d, o in common.arrow_slices(pa.array(texts, pa.string()))]
    unit = np.concatenate([p[0] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
    owner = np.repeat(np.arange(len(toxic)), np.diff(first))
    if not len(owner):
        return None
    keys, seen, bad = _known_units(unit, owner, toxic, settings.least)
    chance = toxic.mean()
    telling = bad / seen >= chance + (1 - chance) * settings.share
    index = HashIndex(keys)
    row = index.find(unit.ravel()).reshape(unit.shape)
    known, row = row >= 0, np.maximum(row, 0)
    # In the sample toxic documents are many; a unit that only toxic ones hold, in least of them, is told by chance
    # rarely, but there are many units: the excess must also be four standard deviations.
    spread = np.sqrt(np.maximum(seen * chance * (1 - chance), 1e-9))
    telling &= (bad - seen * chance) >= 4 * spread
    label = ((known & telling[row]).any(axis=1) & (toxic[owner] == 1)).astype(float)
    weights, bias, moves = np.zeros(len(keys)), -4.0, np.zeros((2, 2))
    squares, squares_rest = np.full(len(keys), 1e-8), np.full(5, 1e-8)
    inner = np.ones(len(label), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    i, state = np.flatnonzero(inner), label.astype(int)
    told = np.bincount(state[i] * 2 + state[i + 1], minlength=4).reshape(2, 2).astype(float)
    used, flat = known.ravel(), row.ravel()
    for _ in range(settings.epochs):
        emission = bias + np.where(known, weights[row], 0.0).sum(axis=1)
        marginal, pairs = forward_backward(emission, moves, first)
        error = label - marginal
        grad = np.bincount(flat[used], weights=np.repeat(error, unit.shape[1])[used], minlength=len(keys)) - settings.decay * len(texts) * weights
        squares += grad**2
        weights += settings.rate * grad / np.sqrt(squares)
        rest = np.concatenate([[error.sum()], (told - pairs).ravel()])
        squares_rest += rest**2
        moved = settings.rate * rest / np.sqrt(squares_rest)
        bias, moves = bias + moved[0], moves + moved[1:].reshape(2, 2)
    model = Model(index, weights, bias, moves, np.zeros(3))
    marginal, _ = forward_backward(model.emissions(unit), moves, first)
    x, w = _evidence(marginal, first), np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (toxic - p) - 0.1 * w)
    model.document = w
    return model


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from a bounded sample of the labelled documents."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    marks = common.bounded_sample(marks, F.col("_toxic"), "doc_id", F.lit(1), settings.rows, settings.rows)
    known = common.only(docs.select("doc_id", common.text_of().alias("_text")), marks.select("doc_id")).join(marks, "doc_id")
    sample = common.bounded_sample(known, F.col("_toxic"), "doc_id", F.octet_length("_text"), settings.rows, settings.bytes)
    rows = sample.select("doc_id", "_text", "_toxic").toArrow().sort_by([("doc_id", "ascending"), ("_text", "ascending")])
    return train(rows["_text"].to_pylist(), rows["_toxic"].to_numpy().astype(float), settings) if rows.num_rows else None


def score(docs: DataFrame, model: Model | None, column: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct column: score and the spans of toxic tokens (start and end in code points, marginal)."""
    kind = "struct<score double, spans array<struct<start int, end int, marginal float>>>"
    if model is None:
        return docs.withColumn(column, F.expr(f"cast(named_struct('score', 0.0D, 'spans', array()) as {kind})"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        frozen = shared.value
        for text in columns:
            scores, counts, starts, ends, chances = [np.zeros(0)], [np.zeros(0, np.int64)], [], [], []
            for _, _, data, offsets in common.arrow_slices(text):
                unit, start, end, first = units(data, offsets)
                marginal, _ = forward_backward(frozen.emissions(unit), frozen.moves, first)
                scores.append(frozen.score(marginal, first))
                found = np.flatnonzero(marginal >= 0.5)
                owner = np.searchsorted(first, found, side="right") - 1
                counts.append(np.bincount(owner, minlength=len(first) - 1))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[offsets[owner]]
                starts.append(points[start[found]] - base)
                ends.append(points[end[found]] - base)
                chances.append(marginal[found])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0)
            spans = pa.StructArray.from_arrays([pa.array(cat(starts).astype(np.int32)), pa.array(cat(ends).astype(np.int32)), pa.array(cat(chances).astype(np.float32))], ["start", "end", "marginal"])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32), spans)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), lists], ["score", "spans"])
        common.give_back()

    return docs.withColumn(column, scored(F.col("text")))
