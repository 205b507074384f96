"""Pyramid vector quantisation: greedy search, and the combinatorial index of a pulse vector.

``index`` numbers the integer vectors of ``n`` places whose absolute values sum to ``k`` in the order of
RFC 6716, 4.3.4.2; ``vector`` undoes it.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4096)
def _row(n: int, most: int) -> tuple[int, ...]:
    """U(n, 0 .. most), where U(n, k) + U(n, k + 1) vectors have n places and k pulses."""
    row = [0] + [1] * most
    for _ in range(n - 1):
        new = [0]
        for k in range(1, most + 1):
            new.append(row[k] + row[k - 1] + new[-1] if k > 1 else 1)
        row = new
    return tuple(row)


def count(n: int, k: int) -> int:
    """How many such vectors there are."""
    if not n:
        return int(k == 0)
    row = _row(n, k + 1)
    return row[k] + row[k + 1]


def index(pulses: list[int]) -> int:
    """Of each place, by what is left after it, and the negative ones after all others."""
    k, total = sum(map(abs, pulses)), 0
    most = k + 1
    for i, p in enumerate(pulses):
        row = _row(len(pulses) - i, most)
        total += row[k - abs(p)] + (row[k + 1] if p < 0 else 0)
        k -= abs(p)
    return total


def vector(number: int, n: int, k: int) -> list[int]:
    out, most = [], k + 1
    for places in range(n, 0, -1):
        row = _row(places, most)
        negative = number >= row[k + 1]
        number -= row[k + 1] if negative else 0
        left = bisect_right(row, number, 0, k + 1) - 1
        number -= row[left]
        out.append(left - k if negative else k - left)
        k = left
    return out


def search(x: np.ndarray, k: int) -> np.ndarray:
    """The pulses of ``k`` that fit ``x`` best, one at a time from none: the largest ``(x.y)^2 / y.y``, the first of equals, in single precision."""
    size = np.abs(x).astype(np.float32)
    y = np.zeros(len(size), np.float32)
    xy = yy = np.float32(0)
    for _ in range(k):
        score = (xy + size) ** 2 / (yy + 2 * y + 1)
        best = int(np.argmax(score))
        xy, yy = xy + size[best], yy + 2 * y[best] + 1
        y[best] += 1
    return np.where(x < 0, -y, y).astype(np.int32)


def unit(pulses: np.ndarray, gain: float = 1.0) -> np.ndarray:
    """Pulses as a vector of the norm ``gain``."""
    norm = float(np.sqrt((pulses.astype(np.float64) ** 2).sum()))
    return pulses * (gain / norm) if norm else pulses.astype(np.float64)
