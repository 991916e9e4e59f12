"""Local part of recompression: consistent symbols over texts of words.

After Jez, "Recompression" (J. ACM 2016): a round names runs of one symbol, then pairs (left, right) after a
split of all symbols into left and right ones. Names and splits are hashes of what they
stand for, so every task names equal runs and pairs alike and a round needs no exchange. Equal substrings get equal symbols except at
their ends; ``extent`` is the stretch of words that decides a symbol, so a symbol whose extent lies in a
window is a function of the window's words alone.
"""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the odd constant of Fibonacci hashing
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
FAR = 1 << 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b * np.uint64(3) + np.uint64(1))


def _neighbours(doc, lo, hi):
    """Extents that include the left, and the right neighbour; beyond a text's end nothing is decided."""
    left, right = np.full(len(lo), -FAR), np.full(len(hi), FAR)
    same = doc[1:] == doc[:-1]
    left[1:][same] = lo[:-1][same]
    right[:-1][same] = hi[1:][same]
    return left, right, same


def name_runs(sym, doc, lo, hi):
    """Replace each run of two or more equal symbols of a text by the name of (symbol, length).

    That a symbol is alone is decided by both its neighbours.
    """
    left, right, same = _neighbours(doc, lo, hi)
    equal = same & (sym[1:] == sym[:-1])
    at = np.flatnonzero(np.concatenate([[True], ~equal]))
    size = np.diff(np.append(at, len(sym)))
    last = at + size - 1
    out = np.where(size > 1, join_names(sym[at], size.astype(np.uint64) + MIX), sym[at])
    return out, doc[at], left[at], right[last]


def name_pairs(sym, doc, lo, hi, level: int):
    """Replace each left symbol that a right one follows, with it, by the pair's name."""
    side = (mix(sym + np.uint64(level)) >> np.uint64(63)).astype(bool)  # True: a left symbol
    left, right, same = _neighbours(doc, lo, hi)
    pair = np.zeros(len(sym), bool)
    pair[:-1] = same & side[:-1] & ~side[1:]
    second = np.concatenate([[False], pair[:-1]])
    # a left symbol looks at the next one, a right symbol at the one before
    new_lo = np.where(side, lo, np.minimum(lo, left))
    new_hi = np.where(side, np.maximum(hi, right), hi)
    out = sym.copy()
    at = np.flatnonzero(pair)
    out[at] = join_names(sym[at], sym[at + 1])
    keep = ~second
    return out[keep], doc[keep], new_lo[keep], new_hi[keep]


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int, window: int):
    """(name, lo, hi) of the symbols of the last round that some window of ``window`` words can decide."""
    n = len(words)
    sym, lo, hi = words, np.arange(n), np.arange(1, n + 1)
    for level in range(1, rounds + 1):
        if len(sym) == 0:
            break
        if level == 1:  # pairs of unequal symbols seldom make new runs; later rounds name pairs only
            sym, doc, lo, hi = name_runs(sym, doc, lo, hi)
        sym, doc, lo, hi = name_pairs(sym, doc, lo, hi, level)
    fits = (lo >= 0) & (hi - lo <= window) & (hi <= n)
    return sym[fits], lo[fits], hi[fits]


def choose(sym, lo, hi, n: int, window: int, shortest: int) -> np.ndarray:
    """For each of the n - window + 1 windows the least name among the symbols whose extent lies in it; NONE where there is none.

    What an interval of k words holds is what its two intervals of k - 1 words hold, and the symbols of its own extent.
    """
    size = hi - lo
    best = np.full(max(0, n - shortest + 1), NONE)
    for k in range(shortest, window + 1):
        if k > shortest:
            best = np.minimum(best[:-1], best[1:])
        own = size == k
        np.minimum.at(best, lo[own], sym[own])
    return best
