"""The modified discrete cosine transform with an overlap window: forward, inverse, and overlap-add.

``n`` coefficients from ``2 n`` samples; with the power-complementary window, overlapping halves add up to
the signal.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=16)
def basis(n: int) -> np.ndarray:
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))


@lru_cache(maxsize=16)
def window(n: int) -> np.ndarray:
    """Rising and falling halves over ``2 n`` samples: sine of a squared sine."""
    rise = np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(n) + 0.5) / (2 * n)) ** 2)
    return np.r_[rise, rise[::-1]]


def forward(frames: np.ndarray) -> np.ndarray:
    """``(m, 2 n)`` samples to ``(m, n)`` coefficients, windowed."""
    n = frames.shape[1] // 2
    return (frames * window(n)) @ basis(n).T


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """``(m, n)`` coefficients to the signal between the first frame's middle and the last one's."""
    m, n = coefficients.shape
    parts = (coefficients @ basis(n)) * (window(n) * 2 / n)
    out = np.zeros((m + 1) * n)
    for i, p in enumerate(parts):
        out[i * n : (i + 2) * n] += p
    return out[n : m * n]
