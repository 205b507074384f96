"""Queries over packets: every document's text, in UTF-8, is a packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bands, framing, speech, toc
from ..session import ship


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("payload"))


def q01_toc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.with_toc(packets(spark, sf_dir)).drop("payload", "toc")


def q02_packet_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toc.with_config(packets(spark, sf_dir))
    samples = toc.samples_per_frame(F.col("mode"), F.col("sample_rate"), F.col("frame_ns"))
    return out.select("doc_id", "mode", "bandwidth", "frame_ns", "sample_rate", samples.alias("frame_samples"))


def q03_packet_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.parse(packets(spark, sf_dir)).select("doc_id", "frame_code", "n_frames", "error")


def q04_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.frames(framing.parse(packets(spark, sf_dir)), with_data=False)
    return out.select("doc_id", "frame_pos", "frame_offset", "frame_length")


def q05_mode_bandwidth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.parse(packets(spark, sf_dir))
    return out.groupBy("mode", "bandwidth", "frame_code").agg(F.count(F.lit(1)).alias("n_packets"), F.count_if(F.col("error").isNull()).alias("n_valid"))


def q06_code3_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.parse(packets(spark, sf_dir)).where("frame_code = 3")
    return out.select("doc_id", "n_frames", "is_vbr", "has_padding")


def q07_padding_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length as a chain of padding bytes: its 255s, then its remainder."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    runs, rest = F.pmod("n_chars", F.lit(7)).cast("int"), F.pmod("n_chars", F.lit(255)).cast("int")
    digits = F.concat(F.repeat(F.lit("FF"), runs), F.lpad(F.hex(rest), 2, "0"))
    rows = docs.select("doc_id", digits.alias("digits"))
    fold = framing.padding(F.col("digits"), F.lit(0), (F.length("digits") / 2).cast("int"))
    return rows.select("doc_id", fold["used"].alias("used"), fold["bytes"].alias("padding_bytes"))


def q08_frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of frames against bytes of packets, by code: what the headers cost."""
    out = framing.parse(packets(spark, sf_dir)).where("error is null")
    body = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("frame_code", F.octet_length("payload").cast("long").alias("n"), body.alias("b")).groupBy("frame_code").agg(F.sum("n").alias("packet_bytes"), F.sum("b").alias("frame_bytes"))


def q09_packet_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.duration_ns(framing.parse(packets(spark, sf_dir)))
    return out.select("doc_id", "packet_ns", (F.col("packet_ns") > framing.LONGEST_NS).alias("too_long"))


def q50_speech_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length as gain indices of four subframes, after an index of 30."""
    n = F.col("n_chars").cast("int")
    deltas = F.array(*(F.pmod(F.floor(n / k).cast("int"), F.lit(41)) for k in (64, 7, 11)))
    rows = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", speech.log_gains(F.pmod(n, F.lit(64)), deltas, F.lit(30)).alias("g"))
    return rows.select("doc_id", *(F.get("g", F.lit(i)).alias(f"g{i}") for i in range(4)), speech.gain_q16(F.get("g", F.lit(3))).alias("gain_q16"))


def q51_pitch_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speech packets' third byte as an absolute lag, their fourth as a relative one."""
    out = toc.with_config(packets(spark, sf_dir)).where("mode = 'Silk-only'")
    a, b = toc.byte_at(F.col("payload"), 2), toc.byte_at(F.col("payload"), 3)
    lag = speech.absolute_lag(F.col("bandwidth"), F.shiftright(a, 3), a.bitwiseAND(3))
    return out.select("doc_id", lag.alias("lag"), speech.relative_lag(lag, F.pmod(b, F.lit(20))).alias("next_lag"))


def q52_coded_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands and bins that each packet's frames code."""
    out = toc.with_config(packets(spark, sf_dir))
    start, end = bands.coded_bands(F.col("mode"), F.col("bandwidth"))
    out = out.select("doc_id", start.alias("start"), end.alias("stop"), F.when(start.isNotNull(), F.round(F.log2(F.col("frame_ns") / 2500000)).cast("int")).alias("size_log")).where("start IS NOT NULL")
    met = out.join(F.broadcast(bands.band_table(spark)), "size_log").where("band >= start AND band < stop")
    return met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_bands"), F.sum("width").alias("n_bins"), F.max("high").alias("last_bin"))


_DIM = ", ".join(str((c, *toc.configuration(c))) for c in range(32))
_BASE = f"""p AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT *, CASE WHEN n > 0 THEN CAST('0x' || substr(h, 1, 2) AS INTEGER) END AS toc FROM p),
u AS (SELECT *, toc >> 3 AS config, toc & 4 <> 0 AS is_stereo, toc & 3 AS frame_code FROM t),
dim(config, mode, bandwidth, frame_ns, sample_rate) AS (VALUES {_DIM}),
v AS (SELECT u.*, mode, bandwidth, frame_ns, sample_rate FROM u LEFT JOIN dim USING (config))"""
# no byte of a text is 255, so padding is one byte here; q07 folds longer chains
_PARSED = f"""{_BASE},
c AS (SELECT *, CASE WHEN frame_code = 3 AND n > 1 THEN CAST('0x' || substr(h, 3, 2) AS INTEGER) END AS cb FROM v),
d AS (SELECT *, CASE WHEN frame_code = 3 THEN cb & 63 WHEN frame_code = 0 THEN 1 WHEN frame_code IS NOT NULL THEN 2 END AS n_frames,
  cb >= 128 AS is_vbr, cb & 64 <> 0 AS has_padding, CASE WHEN cb & 64 <> 0 AND n > 2 THEN CAST('0x' || substr(h, 5, 2) AS INTEGER) END AS pad FROM c),
e AS (SELECT *, CASE WHEN has_padding AND pad IS NOT NULL THEN 3 ELSE 2 END AS head, n - coalesce(pad, 0) AS stop FROM d),
f AS (SELECT *, coalesce(NOT has_padding, true) OR (pad IS NOT NULL AND head <= stop) AS pad_ok, coalesce(n_frames >= 1 AND n_frames * frame_ns <= 120000000, false) AS counted FROM e),
walk AS (
  SELECT doc_id, h, 0 AS k, CASE WHEN frame_code = 2 THEN 1 ELSE head END AS place, CASE WHEN frame_code = 2 THEN n ELSE stop END AS stop,
    CASE WHEN frame_code = 2 THEN 1 ELSE n_frames - 1 END AS todo, CAST([] AS INTEGER[]) AS lens, true AS ok FROM f WHERE frame_code = 2 OR (is_vbr AND pad_ok AND counted)
  UNION ALL
  SELECT doc_id, h, k + 1, place + CASE WHEN good THEN wide ELSE 0 END, stop, todo, CASE WHEN good THEN list_append(lens, CASE WHEN wide = 2 THEN one + 4 * two ELSE one END) ELSE lens END, good FROM (
    SELECT *, ok AND coalesce(place + wide <= stop, false) AS good FROM (SELECT *, CASE WHEN one >= 252 THEN 2 WHEN one IS NOT NULL THEN 1 END AS wide FROM (
      SELECT *, try_cast('0x' || nullif(substr(h, place * 2 + 1, 2), '') AS INTEGER) AS one, try_cast('0x' || nullif(substr(h, place * 2 + 3, 2), '') AS INTEGER) AS two FROM walk WHERE k < todo)))),
w AS (SELECT doc_id, place, stop AS wstop, lens, ok FROM walk WHERE k = todo),
g AS (SELECT f.*, place, lens, ok, wstop - place - coalesce(list_sum(lens), 0) AS rest FROM f LEFT JOIN w USING (doc_id)),
l AS (SELECT *, CASE WHEN frame_code = 0 THEN [n - 1] WHEN frame_code = 1 THEN [(n - 1) // 2, (n - 1) // 2] WHEN lens IS NOT NULL THEN list_append(lens, rest)
  WHEN frame_code = 3 AND n_frames > 0 THEN list_transform(range(n_frames), lambda i: (stop - head) // n_frames) END AS lengths FROM g),
r AS (SELECT *, CASE WHEN n < 1 THEN 'R1' WHEN frame_code = 1 AND (n - 1) % 2 <> 0 THEN 'R3' WHEN frame_code = 2 AND (NOT ok OR rest < 0) THEN 'R4'
  WHEN frame_code = 3 AND NOT counted THEN 'R5' WHEN frame_code = 3 AND NOT pad_ok THEN 'R6' WHEN frame_code = 3 AND NOT is_vbr AND (stop - head) % n_frames <> 0 THEN 'R6'
  WHEN frame_code = 3 AND is_vbr AND (NOT ok OR rest < 0) THEN 'R7' WHEN list_max(lengths) > 1275 THEN 'R2' END AS error,
  CASE WHEN frame_code < 2 THEN 1 WHEN place IS NOT NULL THEN place ELSE head END AS first FROM l)"""

ORACLE = {
    "q01_toc_projection": f"WITH {_BASE} SELECT doc_id, config, is_stereo, frame_code FROM u",
    "q02_packet_config": f"WITH {_BASE} SELECT doc_id, mode, bandwidth, CAST(frame_ns AS BIGINT) AS frame_ns, sample_rate, CAST(CASE WHEN mode = 'Silk-only' THEN sample_rate ELSE 48000 END * CAST(frame_ns AS BIGINT) // 1000000000 AS BIGINT) AS frame_samples FROM v",
    "q03_packet_verdict": f"WITH RECURSIVE {_PARSED} SELECT doc_id, frame_code, CAST(n_frames AS INTEGER) AS n_frames, error FROM r",
    "q04_frames": f"WITH RECURSIVE {_PARSED}, x AS (SELECT doc_id, first, lengths, unnest(range(len(lengths))) AS frame_pos FROM r WHERE error IS NULL) SELECT doc_id, CAST(frame_pos AS INTEGER) AS frame_pos, CAST(first + coalesce(list_sum(lengths[1:frame_pos]), 0) AS INTEGER) AS frame_offset, CAST(lengths[frame_pos + 1] AS INTEGER) AS frame_length FROM x",
    "q05_mode_bandwidth_counts": f"WITH RECURSIVE {_PARSED} SELECT mode, bandwidth, frame_code, count(*) AS n_packets, count(*) FILTER (error IS NULL) AS n_valid FROM r GROUP BY ALL",
    "q06_code3_header": f"WITH RECURSIVE {_PARSED} SELECT doc_id, CAST(n_frames AS INTEGER) AS n_frames, is_vbr, has_padding FROM r WHERE frame_code = 3",
    "q07_padding_fold": "SELECT doc_id, CAST(n_chars % 7 + 1 + CASE WHEN n_chars % 255 = 255 THEN 1 ELSE 0 END AS INTEGER) AS used, CAST(254 * (n_chars % 7) + n_chars % 255 AS INTEGER) AS padding_bytes FROM documents",
    "q08_frame_bytes": f"WITH RECURSIVE {_PARSED} SELECT frame_code, CAST(sum(n) AS BIGINT) AS packet_bytes, CAST(sum(list_sum(lengths)) AS BIGINT) AS frame_bytes FROM r WHERE error IS NULL GROUP BY 1",
    "q50_speech_gains": """WITH n AS (SELECT doc_id, CAST(greatest(n_chars % 64, 30 - 16) AS INTEGER) AS g0, (n_chars // 64) % 41 AS d1, (n_chars // 7) % 41 AS d2, (n_chars // 11) % 41 AS d3 FROM documents),
a AS (SELECT *, CAST(least(greatest(2 * d1 - 16, g0 + d1 - 4, 0), 63) AS INTEGER) AS g1 FROM n), b AS (SELECT *, CAST(least(greatest(2 * d2 - 16, g1 + d2 - 4, 0), 63) AS INTEGER) AS g2 FROM a),
c AS (SELECT *, CAST(least(greatest(2 * d3 - 16, g2 + d3 - 4, 0), 63) AS INTEGER) AS g3 FROM b), l AS (SELECT *, ((CAST(g3 AS BIGINT) * 1907825) >> 16) + 2090 AS x FROM c),
k AS (SELECT *, CAST(1 AS BIGINT) << (x >> 7) AS one, x & 127 AS f FROM l)
SELECT doc_id, g0, g1, g2, g3, CASE WHEN x >= 3967 THEN 2147483647 ELSE one + (one >> 7) * (f + CAST(floor(f * (128 - f) * -174 / 65536) AS BIGINT)) END AS gain_q16 FROM k""",
    "q51_pitch_lags": f"""WITH {_BASE}, b AS (SELECT doc_id, bandwidth, try_cast('0x' || nullif(substr(h, 5, 2), '') AS INTEGER) AS a, try_cast('0x' || nullif(substr(h, 7, 2), '') AS INTEGER) AS c FROM v WHERE mode = 'Silk-only'),
l AS (SELECT *, CASE bandwidth WHEN 'Narrowband' THEN 16 + 4 * (a >> 3) WHEN 'Mediumband' THEN 24 + 6 * (a >> 3) ELSE 32 + 8 * (a >> 3) END + (a & 3) AS lag FROM b) SELECT doc_id, CAST(lag AS INTEGER) AS lag, CAST(lag + c % 20 - 9 AS INTEGER) AS next_lag FROM l""",
    "q52_coded_bins": f"""WITH {_BASE}, e(band, low, high) AS (VALUES {', '.join(str((i, a, z)) for i, (a, z) in enumerate(zip(bands.EDGES, bands.EDGES[1:], strict=False)))}),
c AS (SELECT doc_id, CAST(frame_ns // 2500000 AS INTEGER) AS scale, CASE WHEN mode = 'Hybrid' THEN 17 ELSE 0 END AS a, CASE bandwidth WHEN 'Narrowband' THEN 13 WHEN 'Wideband' THEN 17 WHEN 'Superwideband' THEN 19 ELSE 21 END AS z FROM v WHERE mode <> 'Silk-only')
SELECT doc_id, count(*) AS n_bands, CAST(sum((high - low) * scale) AS BIGINT) AS n_bins, max(high * scale) AS last_bin FROM c JOIN e ON band >= a AND band < z GROUP BY 1""",
    "q09_packet_duration": f"WITH RECURSIVE {_PARSED} SELECT doc_id, CAST(n_frames * CAST(frame_ns AS BIGINT) AS BIGINT) AS packet_ns, n_frames * CAST(frame_ns AS BIGINT) > 120000000 AS too_long FROM r",
}
