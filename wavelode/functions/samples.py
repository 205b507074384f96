"""Sample arithmetic as columns: depth conversion, channel maps, filters of finite reach, energies.

A frame is ``array<float>`` or ``array<double>``; sums run in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCALE = 32768.0


def to_s16(x: Column) -> Column:
    """Float to 16 bits: times 32768, half away from zero, saturated."""
    y = F.round(x.cast("double") * SCALE)
    return F.least(F.greatest(y, F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def from_s16(q: Column) -> Column:
    return q.cast("double") / SCALE


def doubles(frame: Column) -> Column:
    return F.transform(frame, lambda x: x.cast("double"))


def total(frame: Column) -> Column:
    """Sum in order."""
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + x)


def energy(frame: Column) -> Column:
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + x * x)


def abs_sum(frame: Column) -> Column:
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + F.abs(x))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def lagged_dot(frame: Column, lag: Column) -> Column:
    """Sum of x[i] * x[i + lag]."""
    n = F.size(frame)
    return dot(F.slice(frame, F.lit(1), n - lag), F.slice(frame, lag + 1, n - lag))


def stereo_to_mono(frame: Column) -> Column:
    """Mean of interleaved pairs."""
    return F.transform(F.sequence(F.lit(0), (F.size(frame) / 2).cast("int") - 1), lambda i: (F.get(frame, 2 * i) + F.get(frame, 2 * i + 1)) / 2)


def mono_to_stereo(frame: Column) -> Column:
    return F.flatten(F.transform(frame, lambda x: F.array(x, x)))


def dc_block(frame: Column, r: float = 0.995) -> Column:
    """One-pole high pass ``y = x - x[-1] + r y[-1]``: a fold with the two values it carries."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        y = x - acc["x"] + r * acc["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.array_append(acc["out"], y).alias("out"))

    return F.aggregate(frame, start, step)["out"]


def fade_window(n: int) -> list[float]:
    """The squared sine window of an overlap of ``n`` samples."""
    import math

    return [math.sin(math.pi / 2 * math.sin(math.pi * (i + 0.5) / (2 * n)) ** 2) ** 2 for i in range(n)]


def cross_fade(a: Column, b: Column, n: int) -> Column:
    """``a`` fading to ``b`` over ``n`` samples."""
    w = F.array(*(F.lit(v) for v in fade_window(n)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, i) * (1.0 - F.get(w, i)) + F.get(b, i) * F.get(w, i))


def haar(frame: Column) -> Column:
    """One level of the orthonormal butterfly on pairs."""
    half = F.lit(0.7071067811865476)
    pairs = F.sequence(F.lit(0), (F.size(frame) / 2).cast("int") - 1)
    return F.flatten(F.transform(pairs, lambda i: F.array((F.get(frame, 2 * i) + F.get(frame, 2 * i + 1)) * half, (F.get(frame, 2 * i) - F.get(frame, 2 * i + 1)) * half)))


def median(*values: Column) -> Column:
    return F.get(F.array_sort(F.array(*values)), F.lit(len(values) // 2))


def lcg(seed: Column, steps: Column, a: int = 196314165, c: int = 907633515) -> Column:
    """A 32-bit linear congruential generator after some steps, in a long."""
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), seed.cast("long"), lambda s, _: (s * a + c) % 4294967296)


def snr_db(signal: Column, noise: Column, count: Column) -> Column:
    """10 log10 of the energies' ratio; 100 without noise, 0 without samples."""
    return F.when(count == 0, 0.0).when(noise == 0, 100.0).otherwise(10 * F.log10(signal / noise))


def to_channels(frame: Column, channels: int, wanted: int) -> Column:
    """Interleaved samples for another number of channels: a copy to two, the mean to one."""
    if channels == wanted:
        return frame
    return mono_to_stereo(frame) if wanted == 2 else stereo_to_mono(frame)


def add_layers(speech: Column, music: Column) -> Column:
    """The two layers of a hybrid frame: speech goes through 16 bits first, then both add up sample by sample."""
    return F.zip_with(speech, music, lambda a, b: from_s16(to_s16(a)) + b)


def overlay(frame: Column, piece: Column, start: int) -> Column:
    """``piece`` in place of the samples from ``start`` on, as far as both reach."""
    end = F.lit(start) + F.size(piece)
    return F.transform(frame, lambda x, i: F.when((i >= start) & (i < end), F.get(piece, i - start)).otherwise(x))


def fade_in(frame: Column, piece: Column, start: int, n: int) -> Column:
    """From ``piece`` to ``frame`` over ``n`` samples from ``start`` on, in the squared window; the frame elsewhere."""
    w = F.array(*(F.lit(v) for v in fade_window(n)))
    return F.transform(frame, lambda x, i: F.when((i >= start) & (i < start + n), F.get(piece, i - start) * (1.0 - F.get(w, i - start)) + x * F.get(w, i - start)).otherwise(x))


def biased_l1(x: Column, bias: Column) -> Column:
    """The sum of absolute values, raised by a share of itself."""
    return abs_sum(x) * (1 + bias)


def collapse_mask(pulses: Column, blocks: int) -> Column:
    """A bit for each block of equal size that holds a pulse; 1 for a single block."""
    if blocks <= 1:
        return F.lit(1)
    size = F.floor(F.size(pulses) / blocks).cast("int")
    held = (F.exists(F.slice(pulses, i * size + 1, size), lambda p: p != 0).cast("int") * (1 << i) for i in range(blocks))
    return sum(held, F.lit(0))
