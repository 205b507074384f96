"""Side information of the speech layer as columns: gains, pitch lags and spectral interpolation (RFC 6716, section 4.2.7)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

# By bandwidth, the least and largest lag and the step of its high part.
LAGS = {"Narrowband": (16, 144, 4), "Mediumband": (24, 216, 6), "Wideband": (32, 288, 8)}


def log_gains(absolute: Column, deltas: Column, previous: Column) -> Column:
    """The subframes' gain indices: the first is absolute, but at most 16 below the last one; the others are steps.

    A fold that carries the last index.
    """
    first = F.greatest(absolute, previous - 16)
    start = F.struct(first.alias("last"), F.array(first).alias("all"))

    def step(acc: Column, d: Column) -> Column:
        now = F.least(F.greatest(F.greatest(2 * d - 16, acc["last"] + d - 4), F.lit(0)), F.lit(63))
        return F.struct(now.alias("last"), F.array_append(acc["all"], now).alias("all"))

    return F.aggregate(deltas, start, step)["all"]


def gain_q16(index: Column) -> Column:
    """The gain of an index, in Q16."""
    return fixed.log2lin(F.shiftright(index.cast("long") * 0x1D1C71, 16) + 2090)


def absolute_lag(bandwidth: Column, high: Column, low: Column) -> Column:
    """A lag of two parts; null where the bandwidth has none."""
    pick = lambda k: F.coalesce(*(F.when(bandwidth == b, v[k]) for b, v in LAGS.items()))
    return pick(0) + high * pick(2) + low


def relative_lag(previous: Column, index: Column) -> Column:
    return previous + index - 9


def interpolated(last: Column, now: Column, factor: Column) -> Column:
    """Spectral frequencies between two frames, by quarters; 4 is the new ones."""
    return F.zip_with(last, now, lambda a, b: a + F.call_function("shiftright", (b - a) * factor, F.lit(2)))
