"""Signal quality as aggregations: error ratios, bad windows, codec delay, verdicts, and the result matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.samples import snr_db


def align(original: DataFrame, decoded: DataFrame, stream: str, lag: int = 0) -> DataFrame:
    """``stream, n, x, y``: samples ``(stream, n, value)`` of both, the decoded ones ``lag`` later."""
    y = decoded.select(stream, (F.col("n") - lag).alias("n"), F.col("value").alias("y"))
    return original.select(stream, "n", F.col("value").alias("x")).join(y, [stream, "n"])


def snr(pairs: DataFrame, stream: str) -> DataFrame:
    d = F.col("x") - F.col("y")
    sums = pairs.groupBy(stream).agg(F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(d * d).alias("b"), F.count(F.lit(1)).alias("n"))
    return sums.select(stream, snr_db(F.col("a"), F.col("b"), F.col("n")).alias("snr_db"))


def bad_windows(pairs: DataFrame, stream: str, size: int = 480, least_energy: float = 1e4, least_db: float = 3.0) -> DataFrame:
    """``total`` counts all windows; quiet ones, and those without error, are never bad."""
    d = F.col("x") - F.col("y")
    w = pairs.groupBy(stream, F.floor(F.col("n") / size).alias("w")).agg(F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(d * d).alias("b"), F.count(F.lit(1)).alias("n"))
    bad = (F.col("a") / F.col("n") >= least_energy) & (F.col("b") > 0) & (F.col("a") < F.col("b") * 10 ** (least_db / 10))
    return w.groupBy(stream).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"))


def delay(original: DataFrame, decoded: DataFrame, stream: str, lags: int, window: int) -> DataFrame:
    """The lag below ``lags`` of the largest correlation over the first ``window`` samples; the first of equals.

    Each original sample meets the ``lags`` decoded samples that may be its own, by an explode of bounded length.
    """
    x = original.where(F.col("n") < window).select(stream, F.col("n").alias("i"), F.col("value").alias("x"))
    shifted = x.select(stream, "x", "i", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag")).withColumn("n", F.col("i") + F.col("lag"))
    met = shifted.join(decoded.select(stream, "n", F.col("value").alias("y")), [stream, "n"])
    sums = met.groupBy(stream, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("r"))
    rank = Window.partitionBy(stream).orderBy(F.desc("r"), "lag")
    return sums.withColumn("rank", F.row_number().over(rank)).where("rank = 1").select(stream, "lag", "r")


def verdict(found: DataFrame, baseline: DataFrame, key: str, value: str, passes: Column) -> DataFrame:
    """Joins a small baseline by key; a key without baseline passes."""
    return found.join(F.broadcast(baseline), key, "left").withColumn("passed", F.coalesce(passes, F.lit(True)))


def matrix(results: DataFrame, rows: list[str], column: str, values: list[str], passed: str = "passed") -> DataFrame:
    """Pass counts of conformance results, pivoted."""
    return results.groupBy(*rows).pivot(column, values).agg(F.count_if(passed))
