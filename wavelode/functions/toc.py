"""The table-of-contents byte of a packet (RFC 6716, section 3.1) as columns.

A packet is a binary column; every function here is a plain Column expression, so Catalyst prunes,
folds and compiles it.  ``config_table`` is the 32-row dimension the codes join to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names and numbers of the standard's configurations.
MODES = ("Silk-only", "Hybrid", "CELT-only")
BANDWIDTHS = (("Narrowband", 8000), ("Mediumband", 12000), ("Wideband", 16000), ("Superwideband", 24000), ("Fullband", 48000))
SILK_MS, HYBRID_MS, CELT_MS = (10.0, 20.0, 40.0, 60.0), (10.0, 20.0), (2.5, 5.0, 10.0, 20.0)


def configuration(config: int) -> tuple[str, str, int, int] | None:
    """``(mode, bandwidth, frame_ns, sample_rate)`` of a 5-bit code, None beyond 31."""
    if not 0 <= config <= 31:
        return None
    if config < 12:
        mode, band, ms = MODES[0], config // 4, SILK_MS[config % 4]
    elif config < 16:
        mode, band, ms = MODES[1], 3 + (config - 12) // 2, HYBRID_MS[config % 2]
    else:
        mode, band, ms = MODES[2], (0, 2, 3, 4)[(config - 16) // 4], CELT_MS[config % 4]
    name, rate = BANDWIDTHS[band]
    return mode, name, int(ms * 1_000_000), rate


def config_table(spark: SparkSession) -> DataFrame:
    """``config, mode, bandwidth, frame_ns, sample_rate``: 32 rows, built in the plan."""
    rows = [F.struct(F.lit(c).alias("config"), *(F.lit(v).cast("long" if k == "frame_ns" else "int" if k == "sample_rate" else "string").alias(k) for k, v in zip(("mode", "bandwidth", "frame_ns", "sample_rate"), configuration(c), strict=True))) for c in range(32)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def byte_at(payload: Column, index: int | Column) -> Column:
    """The unsigned byte at a place counted from 0; null beyond the end."""
    place = index + 1 if isinstance(index, Column) else F.lit(index + 1)
    digits = F.hex(F.substring(payload, place, F.lit(1)))
    return F.when(F.length(digits) == 2, F.conv(digits, 16, 10).cast("int"))


def config_of(toc: Column) -> Column:
    return F.shiftright(toc, 3)


def is_stereo(toc: Column) -> Column:
    return toc.bitwiseAND(4) != 0


def frame_code(toc: Column) -> Column:
    return toc.bitwiseAND(3)


def toc_byte(config: Column, stereo: Column, code: Column) -> Column:
    """The byte that says so: what an encoder writes."""
    return F.shiftleft(config, 3).bitwiseOR(F.when(stereo, 4).otherwise(0)).bitwiseOR(code)


def celt_config(bandwidth: Column) -> Column:
    """The 20 ms CELT configuration of a bandwidth name (null where there is none)."""
    return F.when(bandwidth == "Narrowband", 19).when(bandwidth == "Wideband", 23).when(bandwidth == "Superwideband", 27).when(bandwidth == "Fullband", 31)


def silk_config(bandwidth: Column) -> Column:
    """The 20 ms SILK configuration of a bandwidth name."""
    return F.when(bandwidth == "Narrowband", 1).when(bandwidth == "Mediumband", 5).when(bandwidth == "Wideband", 9)


def samples_per_frame(mode: Column, sample_rate: Column, frame_ns: Column) -> Column:
    """Samples a channel: at the bandwidth's rate for SILK, at 48 kHz otherwise."""
    rate = F.when(mode == MODES[0], sample_rate).otherwise(48000)
    return F.floor(rate.cast("long") * frame_ns / 1_000_000_000)


def decoded_rate(mode: Column, sample_rate: Column) -> Column:
    """The rate a decoder works at: the bandwidth's for SILK, 48 kHz otherwise."""
    return F.when(mode == MODES[0], sample_rate).when(mode.isNotNull(), 48000).cast("int")


def samples_at(samples: Column, rate: Column) -> Column:
    """Samples of 48 kHz as so many at an output rate."""
    return F.floor(samples.cast("long") * rate / 48000)


def fade_samples(rate: Column) -> Column:
    """The 2.5 ms in which one layer takes over from the other."""
    return F.floor(rate / 400).cast("int")


def redundant_samples(rate: Column) -> Column:
    """The 5 ms of a redundant frame, at an output rate."""
    return F.floor(rate / 200).cast("int")


def with_toc(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``toc, config, is_stereo, frame_code``; null for empty packets."""
    out = packets.withColumn("toc", byte_at(F.col(payload), 0))
    return out.withColumns({"config": config_of(F.col("toc")), "is_stereo": is_stereo(F.col("toc")), "frame_code": frame_code(F.col("toc"))})


def with_config(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the TOC columns and, by a broadcast of 32 rows, what the configuration means."""
    return with_toc(packets, payload).join(F.broadcast(config_table(packets.sparkSession)), "config", "left")
