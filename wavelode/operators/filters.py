"""Filters and predictors over frames in NumPy: comb, stereo, linear prediction, transforms of few steps."""

from __future__ import annotations

import numpy as np

# The comb filter's three tap sets, and the sizes it fades over.
TAPS = np.array([[0.3066406250, 0.2170410156, 0.1296386719], [0.4638671875, 0.2680664062, 0.0], [0.7998046875, 0.1000976562, 0.0]])
FADE, SHORTEST = 120, 15


def _window(n: int) -> np.ndarray:
    return np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(n) + 0.5) / (2 * n)) ** 2)


def comb(x: np.ndarray, history: np.ndarray, old: tuple[int, float, int], new: tuple[int, float, int], recursive: bool, fade: int = FADE) -> np.ndarray:
    """Adds five taps a period back: of the input, or of the output where ``recursive``.

    ``old`` and ``new`` are ``(period, gain, tap set)``; their gains cross over in the squared window.
    ``history`` holds the samples before ``x``.
    """
    old, new = ((max(SHORTEST, t), g, s) for t, g, s in (old, new))
    past = len(history)
    y = np.r_[history, x].astype(np.float64)
    source = y if recursive else y.copy()
    w = np.ones(len(x))
    w[: min(fade, len(x))] = _window(fade)[: len(x)] ** 2
    for i in range(len(x)):
        at = past + i
        for (period, gain, tapset), share in ((old, 1 - w[i]), (new, w[i])):
            if gain and share:
                c, p = TAPS[tapset], at - period
                y[at] += share * gain * (c[0] * source[p] + c[1] * (source[p - 1] + source[p + 1]) + c[2] * (source[p - 2] + source[p + 2]))
    return y[past:]


def stereo_unmix(mid: np.ndarray, side: np.ndarray, weights: tuple[float, float], before: tuple[float, float], ramp: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right from mid and side with two samples of history each; prediction weights ramp over the first samples.

    ``mid`` and ``side`` carry two and one samples before the frame; the output lags one sample.
    """
    n = len(mid) - 2
    share = np.minimum(np.arange(n), ramp) / ramp
    w0 = before[0] + (weights[0] - before[0]) * share
    w1 = before[1] + (weights[1] - before[1]) * share
    smooth = (mid[:-2] + 2 * mid[1:-1] + mid[2:]) / 4
    m, s = mid[1:-1], side[1:-1] if len(side) == n + 2 else side[:n]
    s = s + w0 * smooth + w1 * m
    return np.clip(m + s, -1, 1), np.clip(m - s, -1, 1)


def autocorrelation(x: np.ndarray, order: int) -> np.ndarray:
    return np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])


def levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Prediction and reflection coefficients, and what is left of the energy."""
    order = len(r) - 1
    a, k, left = np.zeros(order), np.zeros(order), float(r[0])
    for i in range(order):
        if left <= 0:
            break
        k[i] = (r[i + 1] - a[:i] @ r[i:0:-1]) / left
        a[:i] -= k[i] * a[:i][::-1]
        a[i] = k[i]
        left *= 1 - k[i] ** 2
    return a, k, left


def step_up(k: np.ndarray) -> np.ndarray:
    """Prediction coefficients of reflection coefficients."""
    a = np.zeros(len(k))
    for i, v in enumerate(k):
        a[:i] -= v * a[:i][::-1]
        a[i] = v
    return a


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Prediction coefficients that least miss forward and backward, and the miss that is left."""
    f, b = x[1:].astype(np.float64), x[:-1].astype(np.float64)
    k = np.zeros(order)
    left = float(x @ x)
    for i in range(order):
        scale = f @ f + b @ b
        k[i] = 2 * (f @ b) / scale if scale > 0 else 0.0
        f, b = (f - k[i] * b)[1:], (b - k[i] * f)[:-1]
        left *= 1 - k[i] ** 2
    return step_up(k), left


def predict_residual(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What prediction from the samples before leaves; the first ``order`` samples are history."""
    order = len(a)
    return x[order:] - sum(a[j] * x[order - 1 - j : len(x) - 1 - j] for j in range(order))


def synthesise(residual: np.ndarray, a: np.ndarray, history: np.ndarray) -> np.ndarray:
    """The inverse of ``predict_residual``; the recursion goes on from unclamped values."""
    order = len(a)
    y = np.r_[history[len(history) - order :], np.zeros(len(residual))]
    for i, v in enumerate(residual):
        y[order + i] = v + a @ y[i : order + i][::-1]
    return y[order:]


def stabilise(nlsf: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Line spectral frequencies in Q15 moved apart to the least gaps (one more than their count), as little as sorting allows."""
    x = np.sort(nlsf.astype(np.int64))
    low = np.cumsum(gaps[:-1])
    high = 32768 - np.cumsum(gaps[:0:-1])[::-1]
    for _ in range(20):
        spread = np.diff(np.r_[0, x, 32768]) - gaps
        worst = int(np.argmin(spread))
        if spread[worst] >= 0:
            return x
        if worst == 0:
            x[0] = gaps[0]
        elif worst == len(x):
            x[-1] = 32768 - gaps[-1]
        else:
            middle = np.clip((x[worst - 1] + x[worst]) // 2, low[worst - 1] + gaps[worst] // 2, high[worst] - (gaps[worst] - gaps[worst] // 2))
            x[worst - 1] = middle - gaps[worst] // 2
            x[worst] = x[worst - 1] + gaps[worst]
    x = np.maximum.accumulate(np.maximum(np.sort(x) - low, 0)) + low
    return np.minimum(x, high)


def _turn_pairs(x: np.ndarray, stride: int, c: float, s: float) -> None:
    """Turns the pairs at a distance, in place: forth, and back without the last ones."""
    n = len(x)
    for i in [*range(n - stride), *range(n - 2 * stride - 1, -1, -1)]:
        x[i], x[i + stride] = c * x[i] - s * x[i + stride], c * x[i + stride] + s * x[i]


def rotate(x: np.ndarray, pulses: int, spread: int, inverse: bool = False, blocks: int = 1) -> np.ndarray:
    """The spreading rotation of a band of interleaved short blocks (RFC 6716, 4.3.4.3), as an encoder does it; ``inverse`` as a decoder.

    None for many pulses or spread 0.  Bands of eight samples a block or more are also turned at a distance of
    about the square root of a block's samples.
    """
    factor = (0, 15, 10, 5)[spread]
    n = len(x)
    y = x.astype(np.float64).copy()
    if not factor or 2 * pulses >= n:
        return y
    gain = n / (n + factor * pulses)
    angle = np.pi / 4 * gain * gain
    c, s = np.cos(angle), np.sin(angle)
    far = 0
    if n >= 8 * blocks:
        far = 1
        while (far * far + far) * blocks + blocks // 4 < n:
            far += 1
    size = n // blocks
    for part in (y[b * size : (b + 1) * size] for b in range(blocks)):
        if inverse:
            if far:
                _turn_pairs(part, far, s, c)
            _turn_pairs(part, 1, c, s)
        else:
            _turn_pairs(part, 1, c, -s)
            if far:
                _turn_pairs(part, far, s, -c)
    return y


def hadamard(x: np.ndarray, stride: int) -> np.ndarray:
    """Interleaved short blocks one after the other."""
    return x.reshape(-1, stride).T.ravel()


def tf_path(cost: np.ndarray, switch: float) -> np.ndarray:
    """The cheapest choice of 0 or 1 for each band, where a change costs ``switch``: two states, forward and back."""
    total, back = cost[0].astype(float).copy(), []
    for c in cost[1:]:
        come = np.array([[total[0], total[1] + switch], [total[0] + switch, total[1]]])
        back.append(np.argmin(come, axis=1))
        total = come.min(axis=1) + c
    path = [int(np.argmin(total))]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


class Reservoir:
    """Variable rate that keeps its promise: what is spent over the rate is owed, its drift is learned slowly.  All in eighths of bits."""

    def __init__(self, constrained: bool = True) -> None:
        self.constrained = constrained
        self.reserve = self.drift = self.offset = self.count = 0

    def frame(self, rate: int, wanted: int, given: int) -> int:
        """Bytes to add to a frame for which ``given`` were granted when ``wanted`` were asked for, at ``rate`` a frame."""
        if self.count < 970:
            self.count += 1
            alpha = np.float32(1) / np.float32(self.count + 20)
        else:
            alpha = np.float32(0.001)
        if not self.constrained:
            return 0
        self.reserve += given - rate
        self.drift += int(alpha * np.float32(wanted - rate - self.offset - self.drift))
        self.offset = -self.drift
        lent, self.reserve = max(0, -self.reserve), max(0, self.reserve)
        return lent >> 6
