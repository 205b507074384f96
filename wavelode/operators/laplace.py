"""Two-sided geometric symbols for the range coder, as the standard defines them for band energies.

The scale is 2**15.  Zero has a given share; each further magnitude has ``decay / 2**14`` of the one before,
halved for its two signs, and no less than one unit; a tail of single units takes the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

from .range_coder import Decoder, Encoder

SCALE, LEAST, TAIL = 32768, 1, 16


def _shares(zero: int, decay: int) -> Iterator[tuple[int, int]]:
    """``(low, share)`` of magnitudes 1, 2, ...: where the pair of signs starts, and one sign's share; 0 begins the tail."""
    low = zero
    share = (SCALE - 2 * LEAST * TAIL - zero) * (16384 - decay) >> 15
    while share > 0:
        yield low, share + LEAST
        low += 2 * (share + LEAST)
        share = 2 * share * decay >> 15
    yield low, 0


def interval(value: int, zero: int, decay: int) -> tuple[int, int, int]:
    """``(low, high, value)``: where a value lies, clamped to the last one of its sign that has a place."""
    if value == 0:
        return 0, zero, 0
    negative, size = value < 0, abs(value)
    for magnitude, (low, share) in enumerate(_shares(zero, decay), 1):
        if share and magnitude == size:
            start = low if negative else low + share
            return start, start + share, value
        if not share:
            # the tail alternates signs, negative first
            room = SCALE - low
            last = (room + 1) // 2 - 1 if negative else room // 2 - 1
            step = min(size - magnitude, last)
            start = low + 2 * step + (not negative)
            return start, start + 1, (magnitude + step) * (-1 if negative else 1)
    raise AssertionError


def encode(coder: Encoder, value: int, zero: int, decay: int) -> int:
    """Codes a value; returns the one that was coded, which predictions must go on from."""
    low, high, value = interval(value, zero, decay)
    coder.encode(low, high, SCALE)
    return value


def decode(coder: Decoder, zero: int, decay: int) -> int:
    at = coder.frequency(SCALE)
    if at < zero:
        coder.take(0, zero, SCALE)
        return 0
    for magnitude, (low, share) in enumerate(_shares(zero, decay), 1):
        if share and at < low + 2 * share:
            negative = at < low + share
            start = low if negative else low + share
            coder.take(start, start + share, SCALE)
            return -magnitude if negative else magnitude
        if not share:
            step, positive = divmod(at - low, 2)
            coder.take(at, at + 1, SCALE)
            return (magnitude + step) * (1 if positive else -1)
    raise AssertionError
