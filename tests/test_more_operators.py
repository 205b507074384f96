import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.config import DecoderConfig, EncoderConfig
from wavelode.functions import fixed
from wavelode.operators import metrics
from wavelode.sources import ogg, records
from wavelode.streaming import packets as live

VALUES = [0, 1, -1, 127, 128, 255, 1000, 32767, 32768, -32768, 65535, 123456789, -123456789, 2**31 - 1, -(2**31)]


def wrap(x):
    x &= 0xFFFFFFFF
    return x - 2**32 if x >> 31 else x


def half(x):
    x &= 0xFFFF
    return x - 2**16 if x >> 15 else x


def test_fixed_point(spark):
    rows = spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a long, b long")
    a, b = F.col("a"), F.col("b")
    out = rows.select("a", "b", fixed.smulwb(a, b).alias("wb"), fixed.smulww(a, b).alias("ww"), fixed.smulbb(a, b).alias("bb"), fixed.smmul(a, b).alias("mm"), fixed.smlawb(a, a, b).alias("acc"), fixed.round_shift(a, 5).alias("r"), fixed.leading_zeros(a).alias("z"), fixed.saturate16(a).alias("s"))
    for r in out.collect():
        assert r.wb == r.a * half(r.b) >> 16 and r.ww == wrap(r.a * r.b >> 16) and r.bb == half(r.a) * half(r.b) and r.mm == r.a * r.b >> 32
        assert r.acc == wrap(r.a + (r.a * half(r.b) >> 16)) and r.r == (r.a + 16) >> 5 and r.s == max(-32768, min(32767, r.a))
        assert r.z == 32 - (r.a & 0xFFFFFFFF).bit_length()


def test_logs(spark):
    rows = spark.createDataFrame([(v,) for v in [1, 2, 3, 100, 4095, 65536, 10**6, 2**30]], "x long")
    for r in rows.select("x", fixed.lin2log(F.col("x")).alias("l"), fixed.log2lin(fixed.lin2log(F.col("x"))).alias("back")).collect():
        assert abs(r.l - 128 * np.log2(r.x)) <= 2 and abs(r.back - r.x) <= max(1, 0.02 * r.x)
    edge = spark.createDataFrame([(-5,), (3967,), (5000,)], "x long").select(fixed.log2lin(F.col("x")).alias("v"))
    assert sorted(r.v for r in edge.collect()) == [0, 2**31 - 1, 2**31 - 1]


def test_configs():
    c = EncoderConfig()
    assert (c.frame_bytes, c.equivalent_rate(), c.chosen_bandwidth()) == (59, 20900, "Fullband")
    assert EncoderConfig(bitrate=8000).chosen_bandwidth() == "Narrowband"
    assert EncoderConfig(max_bandwidth="Wideband").chosen_bandwidth() == "Wideband"
    for bad in ({"bitrate": 5999}, {"channels": 3}, {"complexity": 11}, {"loss_percent": -1}, {"bandwidth": "x"}, {"application": "x"}):
        with pytest.raises(ValueError):
            EncoderConfig(**bad)
    with pytest.raises(ValueError):
        DecoderConfig(sample_rate=44100)


def signal(spark, values, stream="a"):
    return spark.createDataFrame([(stream, i, float(v)) for i, v in enumerate(values)], "stream string, n long, value double")


def test_metrics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1000, 2000)
    y = np.r_[np.zeros(37), x] + np.r_[np.zeros(537), rng.normal(0, 2000, 480), np.zeros(1020)]
    a, b = signal(spark, x), signal(spark, y)
    assert metrics.delay(a, b, "stream", 64, 1500).first().lag == 37
    pairs = metrics.align(a, b, "stream", 37)
    d = x - y[37:]
    assert abs(metrics.snr(pairs, "stream").first().snr_db - 10 * np.log10((x @ x) / (d @ d))) < 1e-9
    w = metrics.bad_windows(pairs, "stream").first()
    bad = sum((p @ p) / len(p) >= 1e4 and e @ e > 0 and (p @ p) / (e @ e) < 10**0.3 for p, e in ((x[i : i + 480], d[i : i + 480]) for i in range(0, 2000, 480)))
    assert (w.total, w.bad) == (5, bad) and bad >= 1
    assert metrics.snr(metrics.align(a, a, "stream"), "stream").first().snr_db == 100


def test_verdict_and_matrix(spark):
    found = spark.createDataFrame([("chirp", 13.0), ("burst", 1.0), ("new", 0.0)], "signal string, snr_db double")
    base = spark.createDataFrame([("chirp", 13.9), ("burst", 4.1)], "signal string, baseline double")
    out = metrics.verdict(found, base, "signal", "snr_db", F.col("baseline") - F.col("snr_db") <= 1.5)
    assert {r.signal: r.passed for r in out.collect()} == {"chirp": True, "burst": False, "new": True}
    results = spark.createDataFrame([(48000, 1, "v1", True), (48000, 1, "v2", False), (8000, 2, "v1", True)], "rate int, channels int, vector string, passed boolean")
    m = {(r.rate, r.channels): (r.v1, r.v2) for r in metrics.matrix(results, ["rate", "channels"], "vector", ["v1", "v2"]).collect()}
    assert m[48000, 1] == (1, 0) and m[8000, 2][0] == 1


def test_records(spark, tmp_path):
    data = records.build_records([(7, b"abc"), (2**32 - 1, b"")]) + b"\0\0\0\5\0\0"
    (tmp_path / "a.bit").write_bytes(data)
    rows = records.read_records(spark, str(tmp_path)).orderBy("record_pos").collect()
    assert [(r.final_range, r.payload and bytes(r.payload), r.error) for r in rows] == [(7, b"abc", None), (2**32 - 1, b"", None), (None, None, "short record")]
    x = np.array([0.0, 0.5, -0.5, 1.5, -1.5, 0.5 / 32768, -0.5 / 32768])
    assert np.frombuffer(records.s16le(x), "<i2").tolist() == [0, 16384, -16384, 32767, -32768, 1, -1]
    frames = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "i int, x array<double>")
    assert [r.pcm and bytes(r.pcm) for r in records.to_pcm(frames, "x").orderBy("i").collect()] == [b"\0\x40\0\x80", None]


def test_baselines(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"version": 1, "bitrate": 96000, "signals": {"chirp": {"tier1SnrDb": 13.9, "tier2WsnrDb": 9.0}}}, indent=1))
    assert [tuple(r) for r in records.read_baseline(spark, str(tmp_path / "q.json")).collect()] == [(1, 96000, "chirp", 13.9, 9.0)]
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "bitrate": 96000, "clips": {"a": {"weightedError": 0.5, "badWindows": 1, "totalWindows": 2999}}}))
    assert records.read_corpus_baseline(spark, str(tmp_path / "c.json")).first().total_windows == 2999


PACKETS = [bytes([i % 256]) * n for i, n in enumerate([10, 255, 70000, 0, 511, 3])]


def test_live_step():
    whole = list(ogg.parse_pages(ogg.build_stream(1, PACKETS)))

    def run(pages):
        state, out = live.Reassembly(), []
        for p in pages:
            state, made = live.step(state, p[2], p[4], p[6])
            out += [m[0] if m[1] is None else m[1] for m in made]
        return state, out

    assert run(whole)[1] == PACKETS
    assert run(whole[1:])[1] == PACKETS[-len(run(whole[1:])[1]) :]
    assert "unexpected end" in run(whole[:1] + whole[2:] if len(whole) > 2 else whole[:1] + [whole[1][:4] + (9,) + whole[1][5:]])[1]


def test_live_stream(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"in{i}").mkdir()
    pages = list(ogg.parse_pages(ogg.build_stream(1, PACKETS)))
    rows = [("s", *p) for p in pages]
    half_way = len(rows) // 2
    source = tmp_path / "pages"
    for part in (rows[:half_way], rows[half_way:]):
        spark.createDataFrame([(*r[:7], [bytearray(s) for s in r[7]], *r[8:]) for r in part], ogg.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(ogg.PAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = live.reassemble(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [bytes(r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.error is None]
    assert sorted(got) == sorted(PACKETS)


def test_rates_of_settings():
    from wavelode.config import DecoderConfig, EncoderConfig

    assert EncoderConfig(bitrate=24_000, complexity=5).threshold_rate() == 22_000 * 95 // 100
    assert EncoderConfig(bitrate=24_000, complexity=4, vbr=True).threshold_rate() == 24_000 * 94 // 100 * 9 // 10
    DecoderConfig(48_000, 2).check_lost(1920)
    with pytest.raises(ValueError):
        DecoderConfig(48_000, 2).check_lost(960)
