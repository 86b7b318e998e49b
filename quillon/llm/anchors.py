"""Content-chosen anchors: which places of a text stand for its windows of MATCH bytes.

Each window of MATCH bytes is given to the gram of GRAM bytes in it whose hash is least (the leftmost of
equal ones). Equal windows, wherever they stand, so have equal grams at equal offsets. Consecutive
windows of one gram form a unit; a text of n bytes has about 2 n / (MATCH - GRAM + 2) of them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from quillon.llm import common

MATCH = 50
GRAM = 16
REACH = MATCH - GRAM + 1  # grams in a window, so windows of a unit at most

#: A window holds its anchor and MATCH - GRAM bytes more: half of them or more on one side.
SIDE = (MATCH - GRAM + 1) // 2

#: Bytes of text worked on at once, about: the arrays made on the way are some hundred times as large.
BLOCK = 150_000
_PLACE = np.uint64((1 << 32) - 1)


class Units(NamedTuple):
    """text, first window, last window and anchor of each unit; hashes of the anchor, of the unit, and of
    SIDE bytes left and right of the anchor with it (0 where no window of the unit holds as much)."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    hash: np.ndarray
    left: np.ndarray
    right: np.ndarray


def units(data: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> Units:
    """The units of texts data[bounds[i]:bounds[i + 1]].

    Texts are taken in runs of about block bytes (one text at least, which is under 4 GB).
    """
    found, start = [], 0
    while not found or start < len(bounds) - 1:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + block, "right")) - 1)
        a = bounds[start]
        some = _units(data[a : bounds[min(end, len(bounds) - 1)]], bounds[start : end + 1] - a)
        found.append(some._replace(row=some.row + start, first=some.first + a, last=some.last + a, place=some.place + a))
        start = end
    return Units(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _units(data: np.ndarray, bounds: np.ndarray) -> Units:
    n = len(data)
    none = Units(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.uint64)))
    if n < MATCH:
        return none
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= eights[k : k + len(h)]
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = h & ~_PLACE
    low |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= REACH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < REACH:
        low = np.minimum(low[: len(low) - (REACH - span)], low[REACH - span :])
    own = (low & _PLACE).astype(np.int32)  # the place of the gram of each window
    begins = np.concatenate(([True], own[1:] != own[:-1]))
    # windows that cross the end of a text are none, and a text's first window begins a unit
    begins[bounds[:-1][bounds[:-1] < len(own)]] = True
    crosses = np.zeros(n + 1, np.int8)
    ends = np.maximum(bounds[1:] - MATCH + 1, bounds[:-1])
    np.add.at(crosses, ends, 1)
    np.add.at(crosses, bounds[1:], -1)
    valid = np.cumsum(crosses[: len(own)], dtype=np.int8) == 0
    first = np.flatnonzero(begins & valid)
    if not len(first):
        return none
    stop = np.concatenate((begins[1:] | ~valid[1:], [True]))
    last = np.flatnonzero(stop & valid)
    place = own[first].astype(np.int64)
    # sums of the gram hashes and of these times their places give each span a hash that knows the order
    at = np.arange(len(h), dtype=np.uint64)
    total, moment = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    np.cumsum(h * at, out=moment[1:])

    def hashes(start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
        upto = start + size - GRAM + 1
        s = total[upto] - total[start]
        m = moment[upto] - moment[start] - s * start.astype(np.uint64)
        return common.mix64(common.mix64(s + np.uint64(0x9E3779B97F4A7C15)) ^ m + common.mix64(np.uint64(1) + seed.astype(np.uint64)))

    size = last + MATCH - first
    sides = []
    for have, start in ((place - first >= SIDE, place - SIDE), (last + MATCH - place - GRAM >= SIDE, place)):
        side = np.zeros(len(first), np.uint64)
        side[have] = hashes(start[have], np.array([GRAM + SIDE]), np.array([1])) | np.uint64(1)
        sides.append(side)
    row = np.searchsorted(bounds, first, "right") - 1
    return Units(row, first, last, place, h[place], hashes(first, size, size * 64 + place - first), *sides)
