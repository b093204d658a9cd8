"""Words of many texts at once: byte ranges and 64-bit hashes, from the UTF-8 bytes of an Arrow column.

A word is a run of ASCII letters or digits and of characters beyond ASCII, but for the Latin-1 signs and the
general punctuation; case is folded for ASCII and Latin-1 letters. Hashes depend on a word's bytes alone.
"""

from __future__ import annotations

import numpy as np

# Words are hashed so many bytes at a time.
PIECE = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        grown = np.full(max(n, 1 << 20), base, np.uint64)
        grown[0] = 1
        _powers[name] = np.multiply.accumulate(grown)
    return _powers[name][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters; no byte changes its place."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        after = data[lead + 1]
        out[lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1] += 32
    return out


def _word_bytes(data: np.ndarray) -> np.ndarray:
    is_word = _WORD[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[(data[two + 1] != 0xAA) & (data[two + 1] != 0xB5) & (data[two + 1] != 0xBA)]
    is_word[two] = is_word[two + 1] = False
    three = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
    is_word[three] = is_word[three + 1] = is_word[three + 2] = False
    return is_word


def _ranges(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.zeros(len(is_word) + 1, bool)
    before[1:] = is_word
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(is_word & ~before[:-1])
    after = np.zeros(len(is_word) + 1, bool)
    after[:-1] = is_word
    after[first] = False
    return starts, np.flatnonzero(is_word & ~after[1:]) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of byte ranges, by differences of one running sum."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1 + salt)) * _power("up", _BASE, n), out=total[1:])
    return mixed((total[ends] - total[starts]) * _power("down", _INVERSE, n + 1)[starts])


def piecewise_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """range_hashes of sorted ranges, a PIECE of the bytes at a time, which bounds the memory of very long texts."""
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        hashes[at:to] = range_hashes(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base, salt)
        at = to
    return hashes


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, hashes, first word of each text and the number of words at the end)."""
    low = folded(data)
    is_word = _word_bytes(low)
    starts, ends = _ranges(is_word, offsets)
    return low, starts, ends, piecewise_hashes(low, starts, ends), np.searchsorted(starts, offsets)


class HashIndex:
    """Row numbers of distinct 64-bit keys in an open-addressing table; -1 for keys that it does not hold."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]
            won = self.rows[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        rows = self.rows[at]
        wrong = np.flatnonzero((rows >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            rows[wrong] = self.rows[at[wrong]]
            wrong = wrong[(rows[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return rows


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (rows of words) over each text; ``first`` has one entry more than there are texts."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(first[:-1] < first[1:])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=np.float64)
    return out
