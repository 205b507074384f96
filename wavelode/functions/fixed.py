"""Fixed-point arithmetic of 32 bits as columns: every value is a long that is wrapped or saturated by rule.

ANSI mode raises on overflow, so products are taken in 64 bits and brought back explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HIGH, LOW = 2**31 - 1, -(2**31)


def wrap32(x: Column) -> Column:
    """The low 32 bits as a signed value."""
    low = x.bitwiseAND(0xFFFFFFFF)
    return F.when(low >= 2**31, low - 2**32).otherwise(low)


def saturate32(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LOW)), F.lit(HIGH))


def saturate16(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-32768)), F.lit(32767))


def low16(x: Column) -> Column:
    """The low 16 bits as a signed value."""
    low = x.bitwiseAND(0xFFFF)
    return F.when(low >= 2**15, low - 2**16).otherwise(low)


def smulbb(a: Column, b: Column) -> Column:
    """Product of the low halves."""
    return low16(a) * low16(b)


def smulwb(a: Column, b: Column) -> Column:
    """A word times a low half, over 2**16."""
    return F.shiftright(a.cast("long") * low16(b), 16)


def smlawb(acc: Column, a: Column, b: Column) -> Column:
    return wrap32(acc + smulwb(a, b))


def smulww(a: Column, b: Column) -> Column:
    """A word times a word, over 2**16."""
    return wrap32(F.shiftright(a.cast("long") * b.cast("long"), 16))


def smmul(a: Column, b: Column) -> Column:
    """The high word of a product."""
    return F.shiftright(a.cast("long") * b.cast("long"), 32)


def round_shift(x: Column, bits: int) -> Column:
    """Divides by a power of two, halves upward."""
    return x if bits == 0 else F.shiftright(F.shiftright(x.cast("long"), bits - 1) + 1, 1)


def leading_zeros(x: Column) -> Column:
    """Of a value in 32 bits; 32 for 0."""
    u = x.bitwiseAND(0xFFFFFFFF)
    return F.when(u == 0, 32).otherwise(32 - F.length(F.bin(u)))


def lin2log(x: Column) -> Column:
    """128 log2 of a positive value, by its leading bit and a parabola over the next seven."""
    zeros = leading_zeros(x)
    shift = 24 - zeros
    u = x.cast("long")
    bits = F.when(shift >= 0, F.call_function("shiftright", u, F.greatest(shift, F.lit(0)))).otherwise(F.call_function("shiftleft", u, F.greatest(-shift, F.lit(0)))).bitwiseAND(127)
    return bits + F.shiftright(bits * (128 - bits) * 179, 16) + (31 - zeros) * 128


def log2lin(x: Column) -> Column:
    """The inverse of ``lin2log``: 0 below 0, the largest value from 3967 on."""
    whole = F.shiftright(x, 7)
    part = x.bitwiseAND(127)
    curve = part + F.shiftright(part * (128 - part) * -174, 16)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.greatest(whole, F.lit(0)), F.lit(31)).cast("int"))
    value = F.when(x < 2048, one + F.shiftright(one * curve, 7)).otherwise(one + F.shiftright(one, 7) * curve)
    return F.when(x < 0, 0).when(x >= 3967, HIGH).otherwise(value)


def mul16_round(a: Column, b: Column) -> Column:
    """Product of the low halves over 2**15, halves upward."""
    return F.shiftright(16384 + low16(a.cast("long")) * low16(b.cast("long")), 15)


def cos_q15(x: Column) -> Column:
    """Cosine of ``x`` / 2**14 quarter turns (64 to 16320), by a parabola of parabolas: the same on every machine."""
    y = F.shiftright(4096 + x.cast("long") * x.cast("long"), 13)
    return 1 + (32767 - y) + mul16_round(y, -7651 + mul16_round(y, 8277 + mul16_round(F.lit(-626), y)))


def log2_tan_q11(sine: Column, cosine: Column) -> Column:
    """2048 log2 of their quotient, both brought to 15 bits."""

    def parts(x: Column) -> tuple[Column, Column]:
        bits = 32 - leading_zeros(x.cast("long"))
        full = F.call_function("shiftleft", x.cast("long"), (15 - bits).cast("int"))
        return bits, mul16_round(full, mul16_round(full, F.lit(-2597)) + 7932)

    (bits_s, curve_s), (bits_c, curve_c) = parts(sine), parts(cosine)
    return (bits_s - bits_c) * 2048 + curve_s - curve_c


def square_root(x: Column) -> Column:
    """The largest integer whose square is not above ``x`` (of 32 bits)."""
    guess = F.floor(F.sqrt(x.cast("double")))
    return F.when(guess * guess > x, guess - 1).when((guess + 1) * (guess + 1) <= x, guess + 1).otherwise(guess)


def fold_mask(fill: Column) -> Column:
    """Pairs of bits of a byte as one bit each: set where either is."""
    pairs = fill.bitwiseOR(F.shiftright(fill, 1))
    return sum((F.shiftleft(F.shiftright(pairs, 2 * i).bitwiseAND(1), i) for i in range(1, 4)), pairs.bitwiseAND(1))


def unfold_mask(mask: Column) -> Column:
    """Each of four bits twice."""
    return sum((F.shiftright(mask, i).bitwiseAND(1) * (3 << 2 * i) for i in range(1, 4)), mask.bitwiseAND(1) * 3)
