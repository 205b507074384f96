"""Geometry of the CELT bands as a small dimension: edges and widths by frame size, coded ranges by bandwidth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Edges of the 21 bands in bins of the 2.5 ms frame, coded bands by bandwidth, and the hybrid's first.
EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100)
CODED = {"Narrowband": 13, "Wideband": 17, "Superwideband": 19, "Fullband": 21}
HYBRID_START = 17


def band_table(spark: SparkSession) -> DataFrame:
    """``size_log, band, low, high, width``: 84 rows, built in the plan."""
    rows = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(a).alias("a"), F.lit(z).alias("z")) for b, (a, z) in enumerate(zip(EDGES, EDGES[1:], strict=False))))
    sizes = spark.range(4).select(F.col("id").cast("int").alias("size_log"), F.inline(rows))
    scale = F.call_function("shiftleft", F.lit(1), F.col("size_log"))
    return sizes.select("size_log", "band", (F.col("a") * scale).alias("low"), (F.col("z") * scale).alias("high"), ((F.col("z") - F.col("a")) * scale).alias("width"))


def coded_bands(mode, bandwidth):
    """``(start, end)`` columns of the bands that a frame codes; null for modes without CELT."""
    start = F.when(mode == "Hybrid", HYBRID_START).when(mode == "CELT-only", 0)
    end = F.coalesce(*(F.when(bandwidth == b, n) for b, n in CODED.items()))
    return start, F.when(start.isNotNull(), end)
