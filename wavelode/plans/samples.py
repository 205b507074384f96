"""Queries over sample frames: every embedding is a frame of 64 samples of the stream its label names, in the order of vec_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import samples as s
from ..functions.bands import EDGES
from ..session import ship
from ..sources.signals import signals

def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL")
    return rows.select("vec_id", "label", s.doubles(F.col("embedding")).alias("x"))


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("n", "x"))


def q10_quantise_s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.transform("x", lambda v: s.to_s16(v))
    out = frames(spark, sf_dir).select("vec_id", q.alias("q"))
    return out.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_min("q").alias("low"), F.array_max("q").alias("high"))


def q11_s16_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.transform("x", lambda v: F.abs(v - s.from_s16(s.to_s16(v))))
    return frames(spark, sf_dir).select("vec_id", F.round(F.array_max(error) * 32768, 6).alias("largest_error"))


def q12_channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono = s.stereo_to_mono(F.col("x"))
    out = frames(spark, sf_dir).select("vec_id", mono.alias("m"))
    return out.select("vec_id", F.size("m").alias("n"), F.round(s.total(F.col("m")), 9).alias("mono_sum"), F.size(s.mono_to_stereo(F.col("m"))).alias("n_stereo"))


def _coarse(x):
    """A sample at 8 bits."""
    return F.round(x * 128) / 128


def q13_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = exploded(spark, sf_dir).select("label", "x", (F.col("x") - _coarse(F.col("x"))).alias("e"))
    sums = y.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("b"), F.count(F.lit(1)).alias("n"))
    return sums.select("label", F.round(s.snr_db(F.col("a"), F.col("b"), F.col("n")), 6).alias("snr_db"))


def q14_bad_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 samples; quiet ones are not judged, and one is bad below 20 dB at 5 bits."""
    y = exploded(spark, sf_dir).withColumn("e", F.col("x") - F.round(F.col("x") * 16) / 16)
    w = y.groupBy("vec_id", "label", F.floor(F.col("n") / 16).alias("w")).agg(F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("b"), F.count(F.lit(1)).alias("n"))
    judged = (F.col("a") / F.col("n") >= 0.001) & (F.col("b") > 0)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(judged & (F.col("a") < F.col("b") * 100)).alias("n_bad"))


def q15_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag from 1 to 31 of the largest correlation; the first of equals."""
    lags = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda k: F.struct(F.round(s.lagged_dot(F.col("x"), k), 9).alias("c"), (-k).alias("k")))
    best = F.array_max(lags)
    return frames(spark, sf_dir).select("vec_id", (-best["k"]).alias("lag"), best["c"].alias("correlation"))


_BASELINE = ((0, 40.0), (1, 30.0), (2, 36.0), (3, 20.0), (5, 50.0))


def q16_regression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream passes when it is at most 1.5 dB below its baseline, or has none."""
    base = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("baseline_db")) for k, v in _BASELINE))))
    out = q13_snr(spark, sf_dir).join(F.broadcast(base), "label", "left")
    return out.select("label", "snr_db", "baseline_db", F.coalesce(F.col("baseline_db") - F.col("snr_db") <= 1.5, F.lit(True)).alias("passed"))


def _by_frame():
    return Window.partitionBy("vec_id").orderBy("n")


def q17_pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = exploded(spark, sf_dir).withColumn("y", 32768 * (F.col("x") - 0.85 * F.lag("x", 1, 0.0).over(_by_frame())))
    return y.groupBy("vec_id").agg(F.round(F.max("y"), 6).alias("high"), F.round(F.min("y"), 6).alias("low"))


def q18_one_sample_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = exploded(spark, sf_dir).withColumn("y", F.lag("x", 1, 0.0).over(_by_frame()))
    return y.select("vec_id", "n", F.round("y", 9).alias("y"))


_TAPS = (0.1, 0.25, 0.3, 0.25, 0.1)


def q19_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = sum((c * F.lag("x", k, 0.0).over(_by_frame()) for k, c in enumerate(_TAPS[1:], 1)), _TAPS[0] * F.col("x"))
    return exploded(spark, sf_dir).withColumn("y", y).groupBy("vec_id").agg(F.round(F.max("y"), 9).alias("high"))


def q20_dc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames(spark, sf_dir).select("vec_id", s.dc_block(F.col("x"), 0.9).alias("y"))
    return out.select("vec_id", F.round(F.element_at("y", -1), 6).alias("last_y"))


def q21_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return frames(spark, sf_dir).select("vec_id", F.round(s.energy(x), 9).alias("energy"), F.round(s.abs_sum(x), 9).alias("abs_sum"), F.round(F.sqrt(s.energy(x) / F.size(x)), 9).alias("rms"))


def q22_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames(spark, sf_dir).select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("lag"))
    return out.select("vec_id", "lag", F.round(s.lagged_dot(F.col("x"), F.col("lag")), 9).alias("r"))


def q23_band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(a).alias("low"), F.lit(z).alias("high")) for b, (a, z) in enumerate(zip(EDGES, EDGES[1:], strict=False))))))
    y = exploded(spark, sf_dir).join(F.broadcast(edges), (F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")))
    return y.groupBy("vec_id", "band").agg(F.round(F.log2(F.sqrt(F.sum(F.col("x") * F.col("x")) + 1e-27)), 6).alias("log_energy"))


def q24_spectral_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = exploded(spark, sf_dir).withColumn("e", F.col("x") * F.col("x") * 64)
    return y.groupBy("label").agg(*(F.count_if(F.col("e") < t).alias(name) for name, t in (("quarter", 0.25), ("sixteenth", 0.0625), ("sixtyfourth", 0.015625))))


def q25_median_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    m3 = F.transform(F.sequence(F.lit(1), F.size(x) - 2), lambda i: s.median(F.get(x, i - 1), F.get(x, i), F.get(x, i + 1)))
    m5 = F.transform(F.sequence(F.lit(2), F.size(x) - 3), lambda i: s.median(*(F.get(x, i + d) for d in range(-2, 3))))
    return frames(spark, sf_dir).select("vec_id", F.round(s.total(m3), 9).alias("median3"), F.round(s.total(m5), 9).alias("median5"))


def q26_top_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four loudest frames of each stream; the earlier of equals."""
    y = frames(spark, sf_dir).select("label", "vec_id", F.round(s.abs_sum(F.col("x")), 9).alias("loudness"))
    y = y.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("loudness"), "vec_id")))
    return y.where("rank <= 4")


def q27_codebook_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the first eight frames, the first of equals: the codebook is a constant of eight rows."""
    rows = frames(spark, sf_dir)
    book = rows.where("vec_id BETWEEN 0 AND 7").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("x").alias("c")))).alias("book"))
    distance = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    best = F.array_min(F.transform("book", lambda e: F.struct(F.round(distance(e["c"]), 9).alias("distance"), e["vec_id"].alias("entry"))))
    out = rows.join(F.broadcast(book), F.lit(True))  # one row
    return out.select("vec_id", best["entry"].alias("entry"), best["distance"].alias("distance"))


def q28_noise_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return rows.select("doc_id", s.lcg(F.col("doc_id") % 4294967296, (F.col("n_chars") % 16).cast("int")).alias("state"))


def q29_haar(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = s.haar(F.col("x"))
    return frames(spark, sf_dir).select("vec_id", F.round(F.get(h, F.lit(0)), 9).alias("first_sum"), F.round(F.get(h, F.lit(1)), 9).alias("first_difference"), F.round(s.energy(h), 9).alias("energy"))


def q30_cross_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame fades into the next one of its stream."""
    w = Window.partitionBy("label").orderBy("vec_id")
    y = frames(spark, sf_dir).withColumn("after", F.lead("x").over(w)).where("after IS NOT NULL")
    return y.select("vec_id", F.round(s.total(s.cross_fade(F.col("x"), F.col("after"), 64)), 9).alias("faded_sum"))


def rate_grid(spark: SparkSession) -> DataFrame:
    """Bit rates from 6 to 510 kb/s by 1 kb/s, one and two channels."""
    return spark.range(6, 511).select((F.col("id") * 1000).cast("int").alias("bitrate"), F.explode(F.array(F.lit(1), F.lit(2))).alias("channels"))


def q31_stereo_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent rate of constant bit rate at complexity 5, and the stereo width it allows in Q14."""
    rate = F.col("bitrate") - F.floor(F.col("bitrate") / 12)
    equivalent = F.floor(rate * 95 / 100)
    width = F.when(equivalent > 32000, 16384).when(equivalent < 16000, 0).otherwise(16384 - F.floor(2048 * (32000 - equivalent) / (equivalent - 14000)))
    return rate_grid(spark).select("bitrate", "channels", equivalent.alias("equivalent"), width.cast("long").alias("width_q14"))


def q32_bandwidth_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_channel = F.floor(F.col("bitrate") / F.col("channels"))
    band = F.when(per_channel < 9000, "Narrowband").when(per_channel < 13500, "Wideband").when(per_channel < 14000, "Superwideband").otherwise("Fullband")
    return rate_grid(spark).select("bitrate", "channels", band.alias("bandwidth"), (F.floor(F.col("bitrate") / 400) - 1).alias("frame_bytes"))


def q38_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate that opens above 0.1 and closes below -0.1: a fold that carries one state."""
    step = lambda a, v: F.struct(F.when(v > 0.1, 1).when(v < -0.1, 0).otherwise(a["on"]).alias("on"), (a["n"] + F.when(v > 0.1, 1).when(v < -0.1, 0).otherwise(a["on"])).alias("n"))
    fold = F.aggregate("x", F.struct(F.lit(0).alias("on"), F.lit(0).alias("n")), step)
    return frames(spark, sf_dir).select("vec_id", fold["n"].alias("n_open"), fold["on"].alias("open_at_end"))


def q48_hybrid_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as speech under the next one of its stream as music."""
    w = Window.partitionBy("label").orderBy("vec_id")
    y = frames(spark, sf_dir).withColumn("after", F.lead("x").over(w)).where("after IS NOT NULL")
    both = s.add_layers(F.col("x"), F.col("after"))
    return y.select("vec_id", F.round(s.total(both), 9).alias("layer_sum"), F.round(F.array_max(both), 9).alias("high"))


def q49_redundancy_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 samples replaced and the next 8 faded by those of the stream's frame before: a mode's transition."""
    w = Window.partitionBy("label").orderBy("vec_id")
    y = frames(spark, sf_dir).withColumn("before", F.lag("x").over(w)).where("before IS NOT NULL")
    start = s.overlay(F.col("x"), F.slice("before", 1, 8), 0)
    out = s.fade_in(start, F.slice("before", 9, 8), 8, 8)
    return y.select("vec_id", F.round(s.total(out), 9).alias("total"))


def q53_test_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy, peak and zero crossings of the synthetic signals."""
    y = signals(ship(spark), 9600).withColumn("v", F.col("value").cast("double"))
    y = y.withColumn("crossed", F.signum("v") * F.signum(F.lag("v", 1, 0.0).over(Window.partitionBy("signal").orderBy("n"))) < 0)
    return y.groupBy("signal").agg(F.round(F.sum(F.col("v") * F.col("v")), 3).alias("energy"), F.round(F.max(F.abs("v")), 5).alias("peak"), F.count_if("crossed").alias("crossings"))


_F = "f AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)"
_E = f"{_F}, e AS (SELECT vec_id, label, unnest(range(len(x))) AS n, unnest(x) AS x FROM f)"
_DOT = "list_sum(list_transform(range(1, len(x) - {k} + 1), lambda i: x[i] * x[i + {k}]))"
_W64 = "[" + ", ".join(repr(v) for v in s.fade_window(64)) + "]"
_W8 = "[" + ", ".join(repr(v) for v in s.fade_window(8)) + "]"
_G = "g AS (SELECT CAST(r * 1000 AS INTEGER) AS bitrate, c AS channels FROM range(6, 511) t(r), (VALUES (1), (2)) v(c))"

ORACLE = {
    "q10_quantise_s16": f"WITH {_F}, q AS (SELECT vec_id, list_transform(x, lambda v: CAST(least(greatest(round(v * 32768), -32768), 32767) AS INTEGER)) AS q FROM f) SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, list_min(q) AS low, list_max(q) AS high FROM q",
    "q11_s16_round_trip": f"WITH {_F} SELECT vec_id, round(list_max(list_transform(x, lambda v: abs(v - least(greatest(round(v * 32768), -32768), 32767) / 32768))) * 32768, 6) AS largest_error FROM f",
    "q12_channel_mix": f"WITH {_F} SELECT vec_id, 32 AS n, round(list_sum(x) / 2, 9) AS mono_sum, 64 AS n_stereo FROM f",
    "q13_snr": f"WITH {_E} SELECT label, round(10 * log10(sum(x * x) / sum((x - round(x * 128) / 128) ** 2)), 6) AS snr_db FROM e GROUP BY 1",
    "q14_bad_windows": f"WITH {_E}, w AS (SELECT vec_id, label, n // 16 AS w, sum(x * x) AS a, sum((x - round(x * 16) / 16) ** 2) AS b, count(*) AS n FROM e GROUP BY ALL) SELECT label, count(*) AS n_windows, count(*) FILTER (a / n >= 0.001 AND b > 0 AND a < b * 100) AS n_bad FROM w GROUP BY 1",
    "q15_best_lag": f"WITH {_F}, c AS (SELECT vec_id, k, round({_DOT.format(k='k')}, 9) AS c FROM f, range(1, 32) t(k)) SELECT vec_id, CAST(k AS INTEGER) AS lag, c AS correlation FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, k) = 1",
    "q16_regression_verdict": f"WITH {_E}, y AS (SELECT label, round(10 * log10(sum(x * x) / sum((x - round(x * 128) / 128) ** 2)), 6) AS snr_db FROM e GROUP BY 1), b(label, baseline_db) AS (VALUES {', '.join(f'({k}, CAST({v} AS DOUBLE))' for k, v in _BASELINE)}) SELECT label, snr_db, baseline_db, coalesce(baseline_db - snr_db <= 1.5, true) AS passed FROM y LEFT JOIN b USING (label)",
    "q17_pre_emphasis": f"WITH {_E}, y AS (SELECT vec_id, CAST(32768 AS DOUBLE) * (x - CAST(0.85 AS DOUBLE) * lag(x, 1, 0) OVER (PARTITION BY vec_id ORDER BY n)) AS y FROM e) SELECT vec_id, round(max(y), 6) AS high, round(min(y), 6) AS low FROM y GROUP BY 1",
    "q18_one_sample_delay": f"WITH {_E} SELECT vec_id, CAST(n AS INTEGER) AS n, round(lag(x, 1, 0) OVER (PARTITION BY vec_id ORDER BY n), 9) AS y FROM e",
    "q19_fir": f"WITH {_E}, y AS (SELECT vec_id, " + " + ".join(f"CAST({c} AS DOUBLE) * lag(x, {k}, 0) OVER (PARTITION BY vec_id ORDER BY n)" for k, c in enumerate(_TAPS)) + " AS y FROM e) SELECT vec_id, round(max(y), 9) AS high FROM y GROUP BY 1",
    "q20_dc_block": f"WITH {_F} SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - CASE WHEN i > 1 THEN x[i - 1] ELSE 0 END) * pow(CAST(0.9 AS DOUBLE), len(x) - i))), 6) AS last_y FROM f",
    "q21_energy": f"WITH {_F} SELECT vec_id, round(list_inner_product(x, x), 9) AS energy, round(list_sum(list_transform(x, lambda v: abs(v))), 9) AS abs_sum, round(sqrt(list_inner_product(x, x) / len(x)), 9) AS rms FROM f",
    "q22_autocorrelation": f"WITH {_F} SELECT vec_id, CAST(k AS INTEGER) AS lag, round({_DOT.format(k='k')}, 9) AS r FROM f, range(0, 17) t(k)",
    "q23_band_energy": f"WITH {_E}, b(band, low, high) AS (VALUES {', '.join(str((i, a, z)) for i, (a, z) in enumerate(zip(EDGES, EDGES[1:], strict=False)))}) SELECT vec_id, band, round(log2(sqrt(sum(x * x) + CAST(1e-27 AS DOUBLE))), 6) AS log_energy FROM e JOIN b ON n >= low AND n < high GROUP BY 1, 2",
    "q24_spectral_cdf": f"WITH {_E} SELECT label, count(*) FILTER (x * x * 64 < 0.25) AS quarter, count(*) FILTER (x * x * 64 < 0.0625) AS sixteenth, count(*) FILTER (x * x * 64 < 0.015625) AS sixtyfourth FROM e GROUP BY 1",
    "q25_median_smoothing": f"WITH {_F} SELECT vec_id, round(list_sum(list_transform(range(2, len(x)), lambda i: list_sort(x[i - 1:i + 1])[2])), 9) AS median3, round(list_sum(list_transform(range(3, len(x) - 1), lambda i: list_sort(x[i - 2:i + 2])[3])), 9) AS median5 FROM f",
    "q26_top_frames": f"WITH {_F}, y AS (SELECT label, vec_id, round(list_sum(list_transform(x, lambda v: abs(v))), 9) AS loudness FROM f) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY loudness DESC, vec_id) AS INTEGER) AS rank FROM y QUALIFY rank <= 4",
    "q27_codebook_search": f"WITH {_F}, d AS (SELECT f.vec_id, c.vec_id AS entry, round(list_sum(list_transform(range(1, 65), lambda i: (f.x[i] - c.x[i]) ** 2)), 9) AS distance FROM f, f c WHERE c.vec_id BETWEEN 0 AND 7) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, entry) = 1",
    "q28_noise_generator": "WITH RECURSIVE w AS (SELECT doc_id, n_chars % 16 AS todo, doc_id % 4294967296 AS state, 0 AS k FROM documents UNION ALL SELECT doc_id, todo, (state * 196314165 + 907633515) % 4294967296, k + 1 FROM w WHERE k < todo) SELECT doc_id, state FROM w WHERE k = todo",
    "q29_haar": f"WITH {_F} SELECT vec_id, round((x[1] + x[2]) * sqrt(0.5), 9) AS first_sum, round((x[1] - x[2]) * sqrt(0.5), 9) AS first_difference, round(list_inner_product(x, x), 9) AS energy FROM f",
    "q30_cross_fade": f"WITH {_F}, y AS (SELECT vec_id, x, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS b, CAST({_W64} AS DOUBLE[]) AS w FROM f) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * (1 - w[i]) + b[i] * w[i])), 9) AS faded_sum FROM y WHERE b IS NOT NULL",
    "q31_stereo_width": f"WITH {_G}, q AS (SELECT *, ((bitrate - bitrate // 12) * 95) // 100 AS equivalent FROM g) SELECT bitrate, channels, CAST(equivalent AS BIGINT) AS equivalent, CAST(CASE WHEN equivalent > 32000 THEN 16384 WHEN equivalent < 16000 THEN 0 ELSE 16384 - (2048 * (32000 - equivalent)) // (equivalent - 14000) END AS BIGINT) AS width_q14 FROM q",
    "q32_bandwidth_choice": f"WITH {_G} SELECT bitrate, channels, CASE WHEN bitrate // channels < 9000 THEN 'Narrowband' WHEN bitrate // channels < 13500 THEN 'Wideband' WHEN bitrate // channels < 14000 THEN 'Superwideband' ELSE 'Fullband' END AS bandwidth, CAST(bitrate // 400 - 1 AS BIGINT) AS frame_bytes FROM g",
    "q48_hybrid_layers": f"WITH {_F}, y AS (SELECT vec_id, x, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM f), z AS (SELECT vec_id, list_transform(range(1, 65), lambda i: least(greatest(round(x[i] * 32768), -32768), 32767) / 32768 + b[i]) AS z FROM y WHERE b IS NOT NULL) SELECT vec_id, round(list_sum(z), 9) AS layer_sum, round(list_max(z), 9) AS high FROM z",
    "q49_redundancy_overlay": f"WITH {_F}, y AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS b, CAST({_W8} AS DOUBLE[]) AS w FROM f) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i <= 8 THEN b[i] WHEN i <= 16 THEN b[i] * (1 - w[i - 8]) + x[i] * w[i - 8] ELSE x[i] END)), 9) AS total FROM y WHERE b IS NOT NULL",
    "q53_test_signals": """WITH RECURSIVE i AS (SELECT n, n / 48000.0::DOUBLE AS t FROM range(9600) r(n)),
z AS (SELECT n, CAST(((n::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616) // 8589934592 AS DOUBLE) / 1073741824 AS e FROM i),
w AS (SELECT CAST(0 AS BIGINT) AS n, 0.6::DOUBLE * e AS v FROM z WHERE n = 0 UNION ALL SELECT w.n + 1, 0.3::DOUBLE * z.e + 0.3::DOUBLE * w.v FROM w JOIN z ON z.n = w.n + 1),
s AS (SELECT 'chirp' AS signal, n, 0.8::DOUBLE * sin(2 * pi() * (200 + 3800 * t / 0.2::DOUBLE) * t) AS v FROM i
UNION ALL SELECT 'harmonics', n, 0.5::DOUBLE * (sin(400 * pi() * t) + sin(800 * pi() * t) / 2 + sin(1200 * pi() * t) / 3 + sin(1600 * pi() * t) / 4 + sin(2000 * pi() * t) / 5) / (1 + 1 / 2::DOUBLE + 1 / 3::DOUBLE + 1 / 4::DOUBLE + 1 / 5::DOUBLE) FROM i
UNION ALL SELECT 'burst', n, CASE WHEN n >= 4800 THEN 0.9::DOUBLE * sin(880 * pi() * t) ELSE 0 END FROM i
UNION ALL SELECT 'shaped_noise', n, v FROM w
UNION ALL SELECT 'onset', n, CASE WHEN n >= 4800 THEN 0.8::DOUBLE * least(1, (n - 4800) / 960::DOUBLE) * sin(880 * pi() * t) ELSE 0 END FROM i),
f AS (SELECT signal, n, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM s), l AS (SELECT *, sign(v) * sign(lag(v, 1, 0) OVER (PARTITION BY signal ORDER BY n)) < 0 AS crossed FROM f)
SELECT signal, round(sum(v * v), 3) AS energy, round(max(abs(v)), 5) AS peak, count(*) FILTER (crossed) AS crossings FROM l GROUP BY 1""",
    "q38_hysteresis": f"WITH RECURSIVE {_F}, w AS (SELECT vec_id, x, 0 AS i, 0 AS o, 0 AS n FROM f UNION ALL SELECT vec_id, x, i + 1, CASE WHEN x[i + 1] > 0.1 THEN 1 WHEN x[i + 1] < -0.1 THEN 0 ELSE o END, n + CASE WHEN x[i + 1] > 0.1 THEN 1 WHEN x[i + 1] < -0.1 THEN 0 ELSE o END FROM w WHERE i < len(x)) SELECT vec_id, CAST(n AS INTEGER) AS n_open, CAST(o AS INTEGER) AS open_at_end FROM w WHERE i = len(x)",
}
