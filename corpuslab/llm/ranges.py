"""Byte ranges of many texts at once: cutting, exact numbering of equal ranges, gathering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpuslab.llm.words import piecewise_hashes

# Bytes compared or gathered in a go, whatever the length of a text.
PIECE = 1 << 22

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def cut(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first range of each text and their number at the end) of the longest stretches of ``inside`` bytes."""
    within = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = within[:-1], within[1:]
    starts = np.flatnonzero(within & (~before | edge[:-1]))
    ends = np.flatnonzero(within & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def pieces(sizes: np.ndarray, most: int = PIECE) -> Iterator[slice]:
    """Slices of ranges with about ``most`` bytes, or of one longer range."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield slice(at, to)
        at = to


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    return all((data[flat(a[part], sizes[part])] == data[flat(b[part], sizes[part])]).all() for part in pieces(sizes))


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each range, one range of each number): two ranges have a number in common where their bytes are equal.

    Ranges meet by a hash and are then compared byte for byte; should two different ones share a hash, a
    dictionary of the bytes numbers all.
    """
    sizes = ends - starts
    _, one, number = np.unique(piecewise_hashes(data, starts, ends), return_index=True, return_inverse=True)
    same = one[number]
    if (sizes == sizes[same]).all() and _equal(data, starts, starts[same], sizes):
        return number, one
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(bytes(data[a:b]), len(seen)) for a, b in zip(starts, ends, strict=True)], np.int64)
    return number, np.unique(number, return_index=True)[1]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, joint: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that the ranges make, each text's ranges with one ``joint`` byte between them."""
    sizes = ends - starts + 1
    last = first[1:][first[1:] > first[:-1]] - 1
    sizes[last] -= 1
    out, at = np.empty(int(sizes.sum()), np.uint8), 0
    ends_at = np.cumsum(sizes)
    for part in pieces(sizes):
        index = np.minimum(flat(starts[part], sizes[part]), len(data) - 1)
        out[at : at + len(index)] = data[index]
        at += len(index)
    joints = np.ones(len(starts), bool)
    joints[last] = False
    out[ends_at[joints] - 1] = joint
    return out, np.concatenate([[0], ends_at])[first]
