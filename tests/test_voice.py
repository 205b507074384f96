import numpy as np

from wavelode.operators import voice


def test_halves_keep_the_energy():
    x = np.random.default_rng(1).standard_normal(4000)
    low, high, _ = voice.split(x, np.zeros(2))
    assert len(low) == len(high) == 2000
    assert abs((low @ low + high @ high) / (x @ x) - 0.5) < 0.02
    tone = np.sin(2 * np.pi * 0.02 * np.arange(4000))
    low, high, _ = voice.split(tone, np.zeros(2))
    assert low @ low > 50 * (high @ high)


def test_speech_stands_out():
    rng = np.random.default_rng(2)
    state, quiet, loud = voice.State(), [], []
    for k in range(120):
        noise = 0.001 * rng.standard_normal(320)
        talk = 60 <= k < 80
        frame = noise + (0.2 * np.sin(2 * np.pi * 0.03 * np.arange(320)) if talk else 0)
        p, _, state = voice.activity(frame, state)
        (loud if talk else quiet).append((k, p))
    assert min(p for _, p in loud) > 0.9
    assert max(p for k, p in quiet if 30 < k < 60) < 0.5


def test_streams(spark):
    rows = [(s, k, [float(0.01 * ((i * (s + 3) + k) % 17 - 8)) for i in range(160)]) for s in range(2) for k in range(5)]
    table = spark.createDataFrame(rows, "s int, k int, x array<double>")
    a = {(r.s, r.k): r.activity for r in voice.activity_streams(table.repartition(4), "s", "k", "x").collect()}
    b = {(r.s, r.k): r.activity for r in voice.activity_streams(table.repartition(1), "s", "k", "x").collect()}
    assert a == b and len(a) == 10
