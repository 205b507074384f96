"""Queries over small columns: rates, integer trigonometry, masks, and the least of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import RATES
from ..functions import fixed, samples as s, toc
from ..session import ship
from .packets import _BASE, packets
from .samples import frames


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").cast("long").alias("n"))


def q54_output_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each packet's frame is at every output rate, with the fade and the redundant frame at it."""
    out = toc.with_config(packets(spark, sf_dir)).where("config IS NOT NULL")
    out = out.withColumn("rate", F.explode(F.array(*map(F.lit, sorted(RATES)))))
    rate = F.col("rate")
    whole = F.floor(F.col("frame_ns").cast("long") * 48000 / 1_000_000_000)
    return out.select("doc_id", "rate", toc.decoded_rate(F.col("mode"), F.col("sample_rate")).alias("decoded_rate"), toc.samples_at(whole, rate).alias("frame_samples"), toc.fade_samples(rate).alias("fade"), toc.redundant_samples(rate).alias("redundant"))


def q55_integer_trigonometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length as an angle: cosine, sine, the logarithm of their quotient, and the root of its square and a bit."""
    rows = _numbers(spark, sf_dir).withColumn("x", F.pmod("n", F.lit(16257)) + 64).withColumns({"cosine": fixed.cos_q15(F.col("x")), "sine": fixed.cos_q15(16384 - F.col("x"))})
    return rows.select("doc_id", "cosine", "sine", fixed.log2_tan_q11(F.col("sine"), F.col("cosine")).alias("log2_tan"), fixed.square_root(F.col("n") * F.col("n") + F.pmod("n", F.lit(97))).alias("root"))


def q56_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits folded and unfolded; which of four short blocks of each frame, at so many eighths, hold a pulse."""
    rows = frames(spark, sf_dir).withColumn("bits", F.pmod("vec_id", F.lit(256)).cast("int"))
    pulses = F.transform("x", lambda v: F.floor(F.abs(v) * 3))
    return rows.select("vec_id", fixed.fold_mask(F.col("bits")).alias("folded"), fixed.unfold_mask(F.col("bits").bitwiseAND(15)).alias("unfolded"), s.collapse_mask(pulses, 4).alias("collapse_mask"))


def q57_quietest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three frames of each stream with the least biased sum of absolute values; the earlier of equals."""
    y = frames(spark, sf_dir).select("label", "vec_id", F.round(s.biased_l1(F.col("x"), F.lit(0.06)), 9).alias("biased_l1"))
    return y.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("biased_l1", "vec_id"))).where("rank <= 3")


_F = "f AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)"


def _mul(a: str, b: str) -> str:
    """The rounded product in SQL; both fit 16 bits here."""
    return f"CAST(floor((16384 + CAST({a} AS BIGINT) * ({b})) / 32768.0) AS BIGINT)"


def _cos(x: str) -> str:
    y = f"((4096 + {x} * {x}) >> 13)"
    return f"(1 + (32767 - {y}) + {_mul(y, f'-7651 + {_mul(y, f'8277 + {_mul(y, str(-626))}')}')})"


def _curve(x: str, bits: str) -> str:
    full = f"({x} << (15 - {bits}))"
    return _mul(full, f"{_mul(full, '-2597')} + 7932")


ORACLE = {
    "q54_output_samples": f"WITH {_BASE}, r(rate) AS (VALUES {', '.join(f'({r})' for r in sorted(RATES))}) SELECT doc_id, rate, CAST(CASE WHEN mode = 'Silk-only' THEN sample_rate ELSE 48000 END AS INTEGER) AS decoded_rate, CAST(CAST(frame_ns AS BIGINT) * 48000 // 1000000000 * rate // 48000 AS BIGINT) AS frame_samples, rate // 400 AS fade, rate // 200 AS redundant FROM v, r WHERE config IS NOT NULL",
    "q55_integer_trigonometry": f"""WITH n AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n, CAST(n_chars % 16257 + 64 AS BIGINT) AS x FROM documents), t AS (SELECT doc_id, n, {_cos('x')} AS cosine, {_cos('(16384 - x)')} AS sine FROM n),
b AS (SELECT *, CAST(length(bin(cosine)) AS BIGINT) AS lc, CAST(length(bin(sine)) AS BIGINT) AS ls FROM t)
SELECT doc_id, cosine, sine, CAST((ls - lc) * 2048 + {_curve('sine', 'ls')} - {_curve('cosine', 'lc')} AS BIGINT) AS log2_tan, CAST(CASE WHEN n % 97 > 2 * n THEN floor(sqrt(n * n + n % 97)) ELSE n END AS BIGINT) AS root FROM b""",
    "q56_masks": f"WITH {_F}, g AS (SELECT *, CAST(vec_id % 256 AS INTEGER) AS b, list_transform(x, lambda v: floor(abs(v) * 3)) AS p FROM f) SELECT vec_id, "
    + "CAST(" + " + ".join(f"(CASE WHEN (b >> {2 * i}) & 3 > 0 THEN {1 << i} ELSE 0 END)" for i in range(4)) + " AS INTEGER) AS folded, "
    + "CAST(" + " + ".join(f"(CASE WHEN (b >> {i}) & 1 > 0 THEN {3 << 2 * i} ELSE 0 END)" for i in range(4)) + " AS INTEGER) AS unfolded, "
    + "CAST(" + " + ".join(f"(CASE WHEN list_max(p[{1 + 16 * i}:{16 + 16 * i}]) > 0 THEN {1 << i} ELSE 0 END)" for i in range(4)) + " AS INTEGER) AS collapse_mask FROM g WHERE len(x) = 64",
    "q57_quietest_frames": f"WITH {_F}, y AS (SELECT label, vec_id, round(list_sum(list_transform(x, lambda v: abs(v))) * 1.06, 9) AS biased_l1 FROM f) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY biased_l1, vec_id) AS INTEGER) AS rank FROM y QUALIFY rank <= 3",
}
