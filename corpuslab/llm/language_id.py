"""Language identification by partial matching: which language's byte statistics encode a text in fewest bits.

Each language has a tree of byte contexts up to ``order`` bytes long. A context that was seen n times with q
different next bytes gives a next byte that followed it c times the probability c / (n + q); what remains is
the escape, after which the context one byte shorter is asked, and below the empty context every byte is
equally likely. Statistics are frozen before scoring, so a text's code length is an exact sum of its bytes'.

Results by definition: ``und`` with score 0 for a text that is null or has no letter, and for every text if
nothing was learned. Ties go to the first language by name. Texts are scored whole; case is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.words import HashIndex, folded, sums_by_text

UNDETERMINED = "und"
_NODES = "lang string, depth int, gram long, seen long"
# The posterior is taken as if at most so many bytes had been read: long texts would all score 1.
EVIDENCE_BYTES = 100
# Bytes scored at a time, whatever the length of a text.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the learned model: training rows and bytes of each language, depth, least count of a node."""

    order: int = 3
    rows: int = 2000
    bytes: int = 1_500_000
    least: int = 2


def _grams(low: np.ndarray, offsets: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each depth the bytes up to and with each position as one number; zero bytes stand before a text."""
    grams = [low.astype(np.uint64)]
    for k in range(1, depth + 1):
        back = np.zeros(len(low), np.uint64)
        back[k:] = low[:-k]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        for j in range(k):
            back[starts[starts + j < len(low)] + j] = 0
        grams.append(grams[-1] | (back << np.uint64(8 * k)))
    return grams


def _count(order: int, least: int):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        column = pa.array(rows["text"], pa.string())
        parts: list[list] = [[] for _ in range(order + 1)]
        for _, _, data, offsets in common.arrow_slices(column):
            for k, g in enumerate(_grams(folded(data), offsets, order)):
                parts[k].append(g)
        out = []
        for k, p in enumerate(parts):
            gram, seen = np.unique(np.concatenate(p) if p else np.zeros(0, np.uint64), return_counts=True)
            out.append(pd.DataFrame({"lang": key[0], "depth": k, "gram": gram.view(np.int64), "seen": seen}))
        return pd.concat(out)

    return count


@dataclass
class Model:
    """Code lengths of all languages by gram, and escapes by context, for each depth."""

    languages: list[str]
    order: int
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grams: list[HashIndex] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[HashIndex] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        low, out = folded(data), np.zeros((len(offsets) - 1, len(self.languages)))
        for begin in range(0, len(low), BLOCK):
            head, end = max(0, begin - self.order), min(begin + BLOCK, len(low))
            # Contexts are right from ``begin`` on: a start that clipping moves to ``head`` spoils only the bytes before.
            bits = self._bits_of_bytes(low[head:end], np.clip(offsets, head, end) - head)[begin - head :]
            out += sums_by_text(bits, np.clip(offsets, begin, end) - begin)
        return out

    def _bits_of_bytes(self, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams = _grams(low, offsets, self.order)
        out = np.zeros((len(low), len(self.languages)), np.float32)
        left = np.arange(len(low))
        for k in range(self.order, -1, -1):
            g = grams[k] if k == self.order else grams[k][left]
            row = self.grams[k].find(g)
            hit = row >= 0
            out[left[hit]] += self.costs[k][row[hit]]
            left, g = left[~hit], g[~hit]
            if not len(left):
                break
            context = self.contexts[k].find(g >> np.uint64(8))
            known = context >= 0
            out[left[known]] += self.escapes[k][context[known]]
        if len(left):
            out[left] += 8.0
        return out


def _tables(nodes: pd.DataFrame, settings: Settings) -> Model:
    languages = sorted(nodes["lang"].unique())
    model, place = Model(languages, settings.order), {x: i for i, x in enumerate(languages)}
    for k in range(settings.order + 1):
        at = nodes[nodes["depth"] == k]
        gram, lang, seen = at["gram"].to_numpy().view(np.uint64), at["lang"].map(place).to_numpy(), at["seen"].to_numpy()
        context = gram >> np.uint64(8)
        all_contexts, c = np.unique(context, return_inverse=True)
        shape = (len(all_contexts), len(languages))
        total, kinds, kept = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        np.add.at(total, (c, lang), seen)
        np.add.at(kinds, (c, lang), 1)
        keep = seen >= (settings.least if k else 1)
        share = seen / (total + kinds)[c, lang]
        np.add.at(kept, (c[keep], lang[keep]), share[keep])
        escape = np.where(total > 0, -np.log2(np.maximum(1 - kept, 1e-9)), 0.0)
        all_grams, g = np.unique(gram[keep], return_inverse=True)
        own = HashIndex(all_contexts).find(all_grams >> np.uint64(8))
        if k:
            below = all_grams & np.uint64((1 << (8 * k)) - 1)
            row = model.grams[-1].find(below)
            lower = np.where((row >= 0)[:, None], model.costs[-1][np.maximum(row, 0)], 0.0)
        else:
            lower = np.full((len(all_grams), len(languages)), 8.0)
        cost = escape[own] + lower
        cost[g, lang[keep]] = -np.log2(share[keep])
        model.grams.append(HashIndex(all_grams))
        model.costs.append(cost.astype(np.float32))
        model.contexts.append(HashIndex(all_contexts))
        model.escapes.append(escape.astype(np.float32))
    return model


def learn(labelled: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Context trees from ``text`` and ``lang`` of ``labelled``; a bounded sample of each language is counted."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    sample = common.bounded_sample(usable, F.col("lang"), "doc_id", F.octet_length("text"), settings.rows, settings.bytes)
    nodes = sample.select("lang", "text").groupBy("lang").applyInPandas(_count(settings.order, settings.least), _NODES).toPandas()
    return _tables(nodes, settings) if len(nodes) else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_lang_score`` (columns of these names are replaced); every other column is carried unchanged."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"_lang_pred": F.lit(UNDETERMINED), "_lang_score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<pred string, score double>")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        frozen = shared.value
        for column in columns:
            preds, scores = [np.zeros(0, np.int32)], [np.zeros(0)]
            for _, _, data, offsets in common.arrow_slices(column):
                bits, n = frozen.bits(data, offsets), np.maximum(np.diff(offsets), 1)
                excess = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(n, EVIDENCE_BYTES) / n)[:, None]
                preds.append(bits.argmin(axis=1).astype(np.int32))
                scores.append(1 / np.exp2(-excess).sum(axis=1))
            names = pa.array(frozen.languages, pa.string()).take(pa.array(np.concatenate(preds)))
            yield pa.StructArray.from_arrays([names, pa.array(np.concatenate(scores))], ["pred", "score"])
        common.give_back()

    made, has = common.fresh([*docs.columns, "_lang_pred", "_lang_score"], "_guess", "_lettered")
    guess = docs.withColumns({made: scored(F.col("text")), has: lettered})
    return guess.withColumns({
        "_lang_pred": F.when(F.col(has), F.col(f"{made}.pred")).otherwise(F.lit(UNDETERMINED)),
        "_lang_score": F.when(F.col(has), F.col(f"{made}.score")).otherwise(F.lit(0.0)),
    }).drop(made, has)
