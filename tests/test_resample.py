import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.operators.resample import DELAYS, RATES_IN, RATES_OUT, Resampler, resample_streams


@pytest.mark.parametrize("rate_in", RATES_IN)
@pytest.mark.parametrize("rate_out", RATES_OUT)
def test_tone(rate_in, rate_out):
    t = np.arange(rate_in // 5) / rate_in
    x = 0.5 * np.sin(2 * np.pi * 440 * t)
    r = Resampler(rate_in, rate_out)
    y = np.concatenate([r.step(p) for p in np.split(x, 10)])
    assert len(y) == rate_out // 5
    tail = y[len(y) // 2 :]
    at = 2 * np.pi * 440 * np.arange(len(y) // 2, len(y)) / rate_out
    basis = np.c_[np.sin(at), np.cos(at)]
    fit, *_ = np.linalg.lstsq(basis, tail, rcond=None)
    assert abs(np.hypot(*fit) - 0.5) < 0.02 and np.abs(basis @ fit - tail).max() < 0.01
    assert r.delay == DELAYS[RATES_IN.index(rate_in)][RATES_OUT.index(rate_out)]


def test_copy_is_a_delay():
    x = np.round(np.random.default_rng(1).uniform(-1, 1, 320) * 32767) / 32768
    y = Resampler(16000, 16000).step(x)
    assert np.array_equal(y[12:], x[:-12]) and not y[:12].any()


def test_frames_do_not_matter_to_state():
    x = np.random.default_rng(2).uniform(-0.9, 0.9, 1600)
    a, b = Resampler(16000, 16000), Resampler(16000, 16000)
    assert np.array_equal(a.step(x), np.concatenate([b.step(p) for p in np.split(x, 5)]))


def test_errors():
    for rates in ((24000, 48000), (16000, 44100)):
        with pytest.raises(ValueError):
            Resampler(*rates)
    with pytest.raises(ValueError):
        Resampler(16000, 48000).step(np.zeros(15))
    with pytest.raises(ValueError):
        Resampler(16000, 12000).step(np.zeros(18 + 16 - 1))
    assert np.abs(Resampler(16000, 48000).step(np.full(320, 1.0))).max() <= 1


def test_streams(spark):
    rows = [(s, k, [float(np.sin(0.1 * (k * 160 + i) * (s + 1))) for i in range(160)]) for s in range(3) for k in range(4)]
    table = spark.createDataFrame(rows, "stream int, k int, x array<double>").repartition(5)
    out = {(r.stream, r.k): r.x for r in resample_streams(table, "stream", "k", "x", 16000, 48000).collect()}
    for s in range(3):
        r = Resampler(16000, 48000)
        for k in range(4):
            assert np.array_equal(r.step(np.array(rows[s * 4 + k][2])), out[s, k])
    assert table.select(F.count("k")).first()[0] == 12
