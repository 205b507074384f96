"""The synthetic test signals as rows ``(signal, n, value)``, computed by Column expressions from the index alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RATE = 48_000
LENGTH = 96_000
#: Terms of the noise's geometric memory: 0.3 ** 24 is below a float's last bit.
MEMORY = 24
# The generator of the noise.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


def _tone(hz: Column | float, t: Column) -> Column:
    return F.sin(2 * math.pi * hz * t)


def _noise(i: Column) -> Column:
    """The high 31 bits of a 64-bit number of the index, over 2**30."""
    seed = F.pmod(i.cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(INCREMENT).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(38,0)"))
    return F.floor(seed / F.lit(2**33).cast("decimal(38,0)")).cast("double") / 2**30


def shaped_noise(i: Column) -> Column:
    """0.3 of the noise and of the value before; the first value is 0.6 of its noise.  The feedback is summed as far as it counts."""
    back = F.sequence(F.lit(0).cast("long"), F.least(i, F.lit(MEMORY)))
    return F.aggregate(back, F.lit(0.0), lambda a, k: a + F.pow(F.lit(0.3), k) * _noise(i - k) * F.when(k == i, 0.6).otherwise(0.3))


def signals(spark: SparkSession, length: int = LENGTH) -> DataFrame:
    """``signal, n, value``: chirp, harmonics, burst, shaped_noise and onset."""
    i, half, fade = F.col("id"), length // 2, RATE // 50
    t = i / RATE
    forms = {
        "chirp": 0.8 * _tone(200 + 3800 * t / (length / RATE), t),
        "harmonics": 0.5 * sum((_tone(200.0 * h, t) / h for h in range(2, 6)), _tone(200.0, t)) / sum(1 / h for h in range(1, 6)),
        "burst": F.when(i >= half, 0.9 * _tone(440.0, t)).otherwise(0.0),
        "shaped_noise": shaped_noise(i),
        "onset": F.when(i >= half, 0.8 * F.least(F.lit(1.0), (i - half) / fade) * _tone(440.0, t)).otherwise(0.0),
    }
    rows = spark.range(length)
    cells = F.array(*(F.struct(F.lit(name).alias("signal"), form.cast("float").alias("value")) for name, form in forms.items()))
    return rows.select(i.alias("n"), F.inline(cells)).select("signal", "n", "value")
