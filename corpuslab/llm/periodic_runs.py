"""Periodic runs of words, found by internal pattern matching, and texts without their repeats.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends, at
least ``least`` words and ``repeats`` periods long. Blocks of b = 1, 2, 4, ... words begin at every b / 2-th word. A run
whose period is more than b / 2 and at most b holds a block that has another b words after it (this needs repeats of 4
or more), and there the block's next occurrence is q words on: sooner, the run would have a smaller period. So each
block asks for its first occurrence in the window of b words after its start: the occurrences of a block are a range of
the suffix array, and the wavelet tree over that array gives the range's least place beyond the start. Such a place is
the second term of a progression, its distance a candidate period, which is then followed to both sides as far as the
words agree. The window of a block of one word is the next word, which is compared at once. Suffixes are sorted by
doubling, as far as half the longest text; words have a number of their own in each text, so no range crosses texts.

Results by definition: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed
text. Words are equal byte for byte. Rows are judged one by one: repeated rows, null and repeated ids change nothing,
and an empty table gives an empty result. Every other column is carried. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common, ranges

RUNS = "struct<runs array<struct<start long, length long, period long>>, n_words long, collapsed string>"


@dataclass(frozen=True)
class Settings:
    least: int = 6
    repeats: int = 4

    def __post_init__(self) -> None:
        if self.repeats < 4:
            raise ValueError("blocks find runs of four periods or more")


class WaveletTree:
    """The values 0 .. n - 1 in some order, by their bits from the highest: counts and order statistics of any range."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, len(values).bit_length())
        self.zeros, self.n_zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.zeros.append(before)
            self.n_zeros.append(int(before[-1]))
            values = np.concatenate([values[low], values[~low]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values in places low .. high - 1 are less than ``bound``."""
        count = np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.zeros[level][low], self.zeros[level][high]
            one = (bound >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            low = np.where(one, self.n_zeros[level] + low - a, a)
            high = np.where(one, self.n_zeros[level] + high - b, b)
        return count

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank, from 0, among those in places low .. high - 1."""
        value = np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.zeros[level][low], self.zeros[level][high]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value |= one.astype(np.int64) << bit
            low = np.where(one, self.n_zeros[level] + low - a, a)
            high = np.where(one, self.n_zeros[level] + high - b, b)
        return value

    def successors(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The least value greater than ``after`` in places low .. high - 1, or -1."""
        rank = self.below(low, high, after + 1)
        there = rank < high - low
        out = np.full(len(low), -1, np.int64)
        out[there] = self.ranked(low[there], high[there], rank[there])
        return out


def block_places(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(suffix array, [(block length, starts, low, high)]): the blocks that occur again, with their ranges in the array.

    ``words`` holds numbers that no two texts share. Only suffixes whose order is still open are sorted further.
    """
    n, longest = len(words), int(np.diff(first).max(initial=0))
    if not n:
        return np.zeros(0, np.int64), []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end, begin = first[1:][text], first[:-1][text]
    array = np.argsort(words, kind="stable")
    sorted_words = words[array]
    head = np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]]))
    size = np.diff(np.append(head, n))
    rank, group = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[array], group[array] = np.repeat(head, size), np.repeat(size, size)
    asked, length = [], 1
    slots = np.flatnonzero(np.repeat(size, size) > 1)
    while True:
        places = array[slots]
        if length > 1:
            at = places[(places - begin[places]) % (length // 2) == 0]
            asked.append((length, at, rank[at], rank[at] + group[at]))
        if not len(places) or 4 * length > longest:
            return array, asked
        onward = places + length
        inside = onward < end[places]
        key = rank[places] * (n + 1) + np.where(inside, rank[np.minimum(onward, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        array[slots] = places
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(places)))
        rank[places], group[places] = np.repeat(slots[starts], size), np.repeat(size, size)
        slots, length = slots[np.repeat(size, size) > 1], 2 * length


def candidates(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances) of the blocks whose next occurrence may be one period on, by distance, then start."""
    joined = words[:-1] == words[1:]
    starts, distances = [np.flatnonzero(joined)], [np.ones(int(joined.sum()), np.int64)]
    array, asked = block_places(words, first)
    tree = WaveletTree(array) if any(len(at) for _, at, _, _ in asked) else None
    for length, at, low, high in asked:
        if len(at):
            apart = tree.successors(low, high, at) - at
            near = (2 * apart > length) & (apart <= length)
            starts.append(at[near])
            distances.append(apart[near])
    start, distance = np.concatenate(starts), np.concatenate(distances)
    order = np.lexsort((start, distance))
    return start[order], distance[order]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the first on are the same; looks at more and more of them."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, step = min(n, at + step), 2 * step
    return n


def runs_of(words: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """Rows (text, start in the slice, length, period) of the runs, by text, start and period."""
    found, last = [], (0, -1, -1)
    start, distance = candidates(words, first)
    text = np.searchsorted(first, start, side="right") - 1
    for t, s, q in zip(text.tolist(), start.tolist(), distance.tolist(), strict=True):
        if last[0] == q and last[1] <= s and s + q < last[2]:
            continue
        low, high = int(first[t]), int(first[t + 1])
        right = s + q + _agree(words[s:high - q], words[s + q : high])
        left = s - _agree(words[low:s][::-1], words[low : s + q][::-1][:s - low])
        last = (q, left, right)
        if right - left >= max(settings.least, settings.repeats * q):
            found.append((t, left, right - left, q))
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def _lists(found: np.ndarray, first: np.ndarray) -> pa.Array:
    n = len(first) - 1
    fields = [pa.array(found[:, 1] - first[found[:, 0]]), pa.array(found[:, 2]), pa.array(found[:, 3])]
    offsets = np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, found: np.ndarray) -> pa.Array:
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, found[:, 1] + found[:, 3], 1)
    np.add.at(depth, found[:, 1] + found[:, 2], -1)
    kept = np.cumsum(depth[:-1]) == 0
    first = np.concatenate([[0], np.cumsum(kept)])[first]
    out, offsets = ranges.gathered(data, starts[kept], ends[kept], first)
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def _runs(settings: Settings):
    @F.arrow_udf(RUNS)
    def runs(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = []
            for _, _, data, offsets in common.arrow_slices(column):
                starts, ends, first = ranges.cut(data, offsets, ~ranges.SPACES)
                number, one = ranges.numbered(data, starts, ends)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                found = runs_of(text * len(one) + number, first, settings)
                parts.append(pa.StructArray.from_arrays(
                    [_lists(found, first), pa.array(np.diff(first)), _collapsed(data, starts, ends, first, found).cast(pa.string())],
                    ["runs", "n_words", "collapsed"],
                ))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
                ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                ("n_words", pa.int64()), ("collapsed", pa.string()),
            ]))
        common.give_back()

    return runs


def find_runs(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``_runs``: the runs by start and period (word numbers from 0), the number of words, and the collapsed text.

    A word is dropped from the collapsed text if any run contains it after that run's first period.
    """
    return docs.withColumn("_runs", _runs(settings)(F.col(text)))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period. Null without a run."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def as_lines(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed, in their order."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def planted(doc_id: Column, text: Column) -> Column:
    """Texts with a known repeat: of ids whose crc32 h has h % 10 = 0, the words from number g % n on, with g = h div 10,
    go round the first 1 + (n - g % n) div (3 + g % 8) of them. Words are joined by one space there; other texts, and
    those without an id, are as they were."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    @F.arrow_udf("string")
    def turned(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, column in columns:
            g, parts = ids.fill_null(0).to_numpy(zero_copy_only=False), []
            for low, high, data, offsets in common.arrow_slices(column):
                starts, ends, first = ranges.cut(data, offsets, ~ranges.SPACES)
                n, mine = np.diff(first), g[low:high]
                a = mine % np.maximum(n, 1)
                p = 1 + (n - a) // (3 + mine % 8)
                text_at = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(starts)) - first[:-1][text_at]
                begin = a[text_at]
                source = first[:-1][text_at] + np.where(i >= begin, begin + (i - begin) % p[text_at], i)
                out, where = ranges.gathered(data, starts[source], ends[source], first)
                parts.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(where.astype(np.int64)), pa.py_buffer(out)).cast(pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        common.give_back()

    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    # The function sees the chosen texts alone; of the others it gets nulls, which cost nothing.
    mine = turned(F.floor(F.when(chosen, h) / 10).cast("long"), F.when(chosen, text))
    return F.when(chosen, mine).otherwise(text)
