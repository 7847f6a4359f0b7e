"""Content-defined anchors: cuts a text's windows among the hash minima they hold.

Every ``window`` bytes of a text hold the same number of ``key``-byte strings;
the one with the least hash (the leftmost of equals) is the window's anchor. It
depends on the window's bytes alone, so two equal windows have the same anchor
at the same place, wherever they stand. The windows of an anchor start side by
side: they make a *piece*.
"""

from __future__ import annotations

import numpy as np
import xxhash

KEY = 128
#: Window starts that are worked on at a time; longer texts are cut there, with their windows whole.
CHUNK = 1 << 18
#: Bits of a place in a chunk. Where hashes agree in all others, the leftmost counts, whatever the size of the data.
PLACE_BITS = 31
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _FACTOR, np.uint64)
    up[0] = 1
    down = np.full(n, _INVERSE, np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CACHE: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _CACHE.get("powers")
    if held is None or len(held[0]) < n:
        held = _CACHE["powers"] = _powers(max(n, CHUNK + (CHUNK >> 2)))
    return held[0][:n], held[1][:n]


def rolling(data: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of the ``key`` bytes from each place."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[key:] - sums[:-key]) * down[: len(data) - key + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[:n] = values
    grid = padded.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def pieces(data: np.ndarray, offsets: np.ndarray, window: int, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts that stand one after the other in ``data``.

    Of each piece: its text, first start and number of starts (both in the
    text), anchor's distance from the first start, and anchor's hash. A single
    text that is longer than CHUNK is cut into chunks that overlap by a window.
    """
    none = np.zeros(0, np.int64)
    if len(offsets) == 2 and len(data) > CHUNK + window:
        found = []
        for low in range(0, len(data) - window + 1, CHUNK):
            part = data[low : low + CHUNK + window - 1]
            text, lo, *rest = pieces(part, np.array([0, len(part)]), window, key)
            found.append((text, lo + low, *rest))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    if not len(data) or np.diff(offsets).max(initial=0) < window:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = rolling(data, key)
    bits = np.uint64(PLACE_BITS)
    least = sliding_least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), window - key + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), starts)
    place = np.repeat(offsets[:-1] - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    anchor = anchor[place]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(place)))
    text, at = owner[first], place[first]
    return text, at - offsets[text], count, anchor[first] - at, h[anchor[first]]


def digests(data: bytes, start: np.ndarray, count: np.ndarray, distance: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each piece: all bytes of its windows, and its anchor's place."""
    ends = (start + count + window - 1).tolist()
    h = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), ends, strict=True)], np.uint64)
    h ^= distance.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return h
