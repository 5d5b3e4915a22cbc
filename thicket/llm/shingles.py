"""Weighted word shingles of a text and their ProbMinHash signature.

Words are runs of other characters than space and U+0009 to U+000D. A shingle is `size` words in a
row; a text of fewer words, but one at least, is one shingle of all its words. A shingle's weight is
1 + ln(the number of times it occurs). Everything is numpy over whole texts: word hashes come from prefix
sums of a polynomial modulo 2**64, then are mixed, and five of them make a shingle's hash.
"""

from __future__ import annotations

import math

import numpy as np

SIZE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2, _GAMMA = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    letters = np.frombuffer(raw, dtype=np.uint8)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (letters != 32) & ((letters < 9) | (letters > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(raw: bytes, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes, ascending, and how often each occurs."""
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    take = min(size, n)
    total = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        factor = np.uint64((_GAMMA * (2 * k + 3)) & _MASK | 1)
        total += mix(words[k : n - take + 1 + k] * factor + np.uint64(k))
    return np.unique(mix(total), return_counts=True)


def damped(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signature(hashes: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash: each register's winning element.

    Each element is a Poisson process of points at a rate of its weight, and each point falls into a
    random register; the earliest point in a register wins it. Two texts' registers agree with the
    probability Jaccard similarity as probability. An element's process stops once it is later than
    every register's earliest point.
    """
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, dtype=np.uint64)
    live, weight, at, drawn = hashes, weights.astype(np.float64), np.zeros(len(hashes)), 0
    while len(live):
        # Rounds of one point each for many elements; of more for few, as registers must fill up.
        points = max(1, min(1024, int(registers * math.log(registers) * 1.5) // len(live)))
        steps = (np.arange(drawn, drawn + points, dtype=np.uint64) + np.uint64(1)) * np.uint64(_GAMMA)
        bits = mix(live[:, None] + steps[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        times = at[:, None] + np.cumsum(gaps, axis=1)
        into = (mix(bits + np.uint64(1)) % np.uint64(registers)).astype(np.int64).ravel()
        flat = times.ravel()
        soon = np.flatnonzero(flat < first.max()) if drawn else np.arange(len(flat))
        soon = soon[np.argsort(-flat[soon], kind="stable")]  # the earliest is written last
        best, who = np.full(registers, np.inf), np.zeros(registers, dtype=np.uint64)
        best[into[soon]] = flat[soon]
        who[into[soon]] = live[soon // points]
        better = best < first
        first[better], winner[better] = best[better], who[better]
        drawn += points
        going = times[:, -1] < first.max()
        live, weight, at = live[going], weight[going], times[going, -1]
    return winner


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exactly, of two weighted sets (hashes ascending, weights): for each common element the
    reciprocal of sum(max(x' / x, y' / y)) over all elements. Sorted by x / y, either term of the
    maximum prevails on one side, so running sums do."""
    if not len(a) or not len(b):
        return 0.0
    both, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    xs, ys = x[in_a].astype(np.float64), y[in_b].astype(np.float64)
    order = np.argsort(xs / ys, kind="stable")
    xs, ys = xs[order], ys[order]
    ratio = xs / ys
    only_a, only_b = float(x.sum()) - xs.sum(), float(y.sum()) - ys.sum()
    low = np.searchsorted(ratio, ratio, side="left")
    sum_y = np.concatenate([[0.0], np.cumsum(ys)])[low] + only_b  # elements with a smaller ratio
    sum_x = only_a + xs.sum() - np.concatenate([[0.0], np.cumsum(xs)])[low]
    return float((1.0 / (sum_x / xs + sum_y / ys)).sum())
