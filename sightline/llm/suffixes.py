"""Suffix order, common prefixes and longest-previous-factor arrays, up to a depth."""

from __future__ import annotations

import numpy as np


def ladder(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank) for sizes 8, 16, 32 ... up to depth: ranks of the ``size`` bytes from each place, in byte order, equal for equal bytes.

    Places with fewer bytes left are padded with zero bytes.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    found = [(8, np.unique(word, return_inverse=True)[1].astype(np.int64))]
    while found[-1][0] * 2 <= depth:
        size, rank = found[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        found.append((2 * size, np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)))
    return found


def suffix_order(steps: list[tuple[int, np.ndarray]], starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their ``depth`` bytes (equal ones by place), and the common prefix of each with the one before, up to depth (0 for the first).

    ``depth`` is a multiple of 8, and every start has that many bytes left.
    """
    keys, at, left = [], starts, depth
    for size, rank in reversed(steps):
        while left >= size:
            keys.append(rank[at])
            at, left = at + size, left - size
    order = np.lexsort([starts, *keys[::-1]])
    sa = starts[order]
    a, b = sa[:-1].copy(), sa[1:].copy()
    common, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for size, rank in reversed(steps):
        while True:
            # one more step of this size for the pairs that agree on it and may go on
            go = same & (common + size <= depth)
            go[go] = rank[a[go]] == rank[b[go]]
            if not go.any():
                break
            common[go] += size
            a[go] += size
            b[go] += size
            a[common >= depth], b[common >= depth] = 0, 0
            same &= common < depth
    return sa, np.append(0, common) if len(sa) else common


def nearest_smaller(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry of the suffix order, its common prefix with the nearest entry before it that starts earlier in the text; 0 if there is none.

    Pointers jump over entries that start later, together with the least common
    prefix on the way, until none moves.
    """
    n = len(sa)
    to, least = np.arange(n) - 1, lcp.copy()
    while True:
        move = np.flatnonzero((to >= 0) & (sa[np.maximum(to, 0)] > sa))
        move = move[least[move] > 0]
        if not len(move):
            break
        through = to[move]
        least[move], to[move] = np.minimum(least[move], least[through]), to[through]
    return np.where(to >= 0, least, 0)


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry of the suffix order: the longer of the matches at its previous and next smaller positions."""
    below = nearest_smaller(sa, lcp)
    turned = np.append(0, lcp[1:][::-1]) if len(lcp) else lcp
    above = nearest_smaller(sa[::-1], turned)[::-1]
    return np.maximum(below, above)


def repeats(data: np.ndarray, starts: np.ndarray, depth: int, later_only: bool) -> np.ndarray:
    """The starts, in rising order, whose ``depth`` bytes also start at an earlier start (or, unless later_only, at any other)."""
    if not len(starts):
        return starts
    sa, lcp = suffix_order(ladder(data, depth), np.asarray(starts, np.int64), depth)
    factor = previous_factors(sa, lcp)
    if not later_only:
        factor = np.maximum(factor, previous_factors(-sa, lcp))
    return np.sort(sa[factor >= depth])
