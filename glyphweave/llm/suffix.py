"""Suffix arrays in numpy: Larsson-Sadakane refinement, common prefixes after Kasai, lookup by binary search."""

from __future__ import annotations

import numpy as np


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; zeros stand beyond the end."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(data),), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Positions of all suffixes in order; a suffix sorts before its extensions.

    Larsson-Sadakane: sort by a prefix of h bytes, then sort each group of equal prefixes by the rank
    of what follows h bytes on, doubling h. A position's rank is its group's first place, and groups of
    one are never touched again.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    key = words8(data) if first is None else first
    sa = np.argsort(key)  # the order within a group doesn't matter
    ordered = key[sa]
    heads = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 8
    place = _unsorted(heads)
    while len(place):
        at = sa[place]
        group = rank[at]
        beyond = at + h
        # A suffix that has ended sorts first, the shorter before the longer.
        follow = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1 + h, np.maximum(n - beyond, -h) + h)
        key = group * np.int64(n + h + 2) + follow
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[place] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        place = place[_unsorted(new)]
        h *= 2
    return sa


def _unsorted(heads: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, given which places begin a group."""
    alone = heads & np.concatenate((heads[1:], [True]))
    return np.flatnonzero(~alone)


def common_prefixes(data: np.ndarray, sa: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """For each place of the suffix array, the bytes its suffix shares with the one before (0 at place 0).

    Kasai's rule, in text order: a suffix shares at least one byte less than the suffix one position
    before it, and exactly that if the bytes before it and before its predecessor are equal. So only
    the others are compared, 8 bytes a step and all at once, and the rest follows by counting down.
    """
    n = len(sa)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    key = words8(data) if first is None else first
    before = np.empty(n, dtype=np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    p = np.arange(n)
    compared = (before < 0) | (p == 0) | (before == 0)
    compared |= data[p - 1] != data[before - 1]
    p = p[compared & (before >= 0)]
    shared = np.zeros(n, dtype=np.int64)
    q, live, offset = before[p], np.arange(len(p)), np.zeros(len(p), dtype=np.int64)
    while len(live):
        a, b = p[live] + offset[live], q[live] + offset[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        diff = key[a] ^ key[b]
        same = diff == 0
        ended = live[~same]
        offset[ended] += _leading_zero_bytes(diff[~same])
        live = live[same]
        offset[live] += 8
    shared[p] = np.minimum(offset, n - np.maximum(p, q))
    shared[compared & (before < 0)] = 0
    index = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    shared = shared[index] - (np.arange(n) - index)
    return shared[sa]


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for bits, count in ((32, 4), (16, 2), (8, 1)):
        clear = (x >> np.uint64(64 - bits)) == 0
        out += np.where(clear, count, 0)
        x = np.where(clear, x << np.uint64(bits), x)
    return out


def found_in(needles: np.ndarray, data: np.ndarray, starts: np.ndarray, size: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the strings of `size` bytes from positions `needles[1]` of `needles[0]`-like text.

    needles: (m, size) uint8. data, starts: a text and positions of strings of `size` bytes in it, in
    order. Returns which needles are there, and for each the least place in `starts` that isn't below it.
    """
    hit = np.zeros(len(needles), dtype=bool)
    place = np.zeros(len(needles), dtype=np.int64)
    span = np.arange(size)
    for lo in range(0, len(needles), block):
        part = needles[lo : lo + block]
        a = np.zeros(len(part), dtype=np.int64)
        b = np.full(len(part), len(starts), dtype=np.int64)
        while (live := np.flatnonzero(a < b)).size:
            mid = (a[live] + b[live]) // 2
            below = _less(data[starts[mid][:, None] + span], part[live])
            a[live[below]] = mid[below] + 1
            b[live[~below]] = mid[~below]
        inside = np.flatnonzero(a < len(starts))
        hit[lo + inside] = (data[starts[a[inside]][:, None] + span] == part[inside]).all(axis=1)
        place[lo : lo + block] = a
    return hit, place


def _less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each row of x sorts before that of y."""
    differ = x != y
    at = differ.argmax(axis=1)
    rows = np.arange(len(x))
    return differ[rows, at] & (x[rows, at] < y[rows, at])
