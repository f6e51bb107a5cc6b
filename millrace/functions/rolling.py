"""Hashes of all runs of k consecutive characters of a text, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    """One uint32 per Unicode code point."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits; changes h in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """uint64 polynomial hash, mixed, of each run of k code points; empty when there are fewer.

    Runs of length 1, 2, 4, ... are joined along the binary digits of k, so a run costs about
    2 log2(k) multiplications instead of k.
    """
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = points.astype(np.uint64) + np.uint64(1)
    width, out, done = 1, None, 0
    while True:
        if k & width:
            if out is None:
                out = power[: len(points) - width + 1]
            else:
                m = len(points) - done - width + 1
                out = out[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + m]
            done += width
        if done == k:
            return mix(out[:n].copy() if out.base is not None else out[:n])
        m = len(power) - width
        power = power[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2


def distinct_shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k characters of text."""
    h = rolling(code_points(text), k)
    if not len(h):
        return h
    h.sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def sliding(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """ufunc (np.minimum or np.maximum) over each window of width values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = ufunc(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return ufunc(out[:-rest], out[rest:]) if rest else out
