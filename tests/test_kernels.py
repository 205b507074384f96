import random

import numpy as np

from wavelode.functions.crc import ogg_crc
from wavelode.operators import conceal, mdct, pvq, soft_clip
from wavelode.operators.range_coder import Decoder, Encoder


def test_checksum():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        return c

    for n in (0, 1, 7, 300):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert ogg_crc(data) == slow(data)


def test_range_coder_round_trip():
    rng = random.Random(5)
    table = [224, 112, 40, 7, 0]
    for _ in range(400):
        coder, said = Encoder(), []
        for _ in range(rng.randrange(60)):
            kind = rng.choice("ubire")
            if kind == "u":
                a = rng.choice([2, 3, 17, 256, 300, 70000, 1 << 20])
                v = rng.randrange(a)
                coder.uniform(v, a)
            elif kind == "b":
                a, v = rng.randrange(1, 16), rng.randrange(2)
                coder.bit_logp(v, a)
            elif kind == "i":
                a, v = table, rng.randrange(5)
                coder.icdf(v, a, 8)
            elif kind == "r":
                a = rng.randrange(1, 20)
                v = rng.randrange(1 << a)
                coder.raw(v, a)
            else:
                a = rng.randrange(2, 1000)
                low = rng.randrange(a)
                v = (low, rng.randrange(low + 1, a + 1))
                coder.encode(*v, a)
            said.append((kind, a, v))
        tell, width = coder.tell(), coder.range
        back = Decoder(coder.finish(rng.choice([None, 400])))
        for kind, a, v in said:
            if kind == "u":
                assert back.uniform(a) == (v, True)
            elif kind == "b":
                assert back.bit_logp(a) == v
            elif kind == "i":
                assert back.icdf(a, 8) == v
            elif kind == "r":
                assert back.raw(a) == v
            else:
                assert v[0] <= back.frequency(a) < v[1]
                back.take(*v, a)
        assert (back.tell(), back.range) == (tell, width)


def test_pulse_index_order():
    assert [pvq.vector(i, 2, 1) for i in range(4)] == [[1, 0], [0, 1], [0, -1], [-1, 0]]
    assert [pvq.vector(i, 2, 2) for i in range(8)] == [[2, 0], [1, 1], [1, -1], [0, 2], [0, -2], [-2, 0], [-1, 1], [-1, -1]]
    assert [pvq.vector(i, 3, 1) for i in range(6)] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, -1], [0, -1, 0], [-1, 0, 0]]
    # sizes by the recurrence V(n, k) = V(n - 1, k) + V(n, k - 1) + V(n - 1, k - 1)
    for n in range(2, 9):
        for k in range(1, 9):
            assert pvq.count(n, k) == pvq.count(n - 1, k) + pvq.count(n, k - 1) + pvq.count(n - 1, k - 1)


def test_soft_clip_by_samples():
    # each sample in turn, in single precision: an excursion is bent whole; one from the frame's start gets a ramp lowered before its first sample
    f = np.float32

    def plain(x, curve):
        x = [max(f(-2), min(f(2), f(v))) for v in x]
        i = 0
        while i < len(x) and x[i] * curve < 0:
            x[i] += curve * x[i] * x[i]
            i += 1
        first, at = x[0], 0
        while True:
            over = [i for i in range(at, len(x)) if abs(x[i]) > 1]
            if not over:
                return x, f(0)
            i = start = end = peak = over[0]
            sign = x[i]
            while start and sign * x[start - 1] >= 0:
                start -= 1
            while end < len(x) and sign * x[end] >= 0:
                peak = end if abs(x[end]) > abs(x[peak]) else peak
                end += 1
            opened = start == 0 and sign * x[0] >= 0
            top = abs(x[peak])
            curve = (top - f(1)) / (top * top)
            curve += curve * f(2.4e-7)
            curve = -curve if sign > 0 else curve
            for j in range(start, end):
                x[j] += curve * x[j] * x[j]
            if opened and peak >= 2:
                offset = first - x[0]
                step = offset / f(peak)
                for j in range(at, peak):
                    offset -= step
                    x[j] = max(f(-1), min(f(1), x[j] + offset))
            at = end
            if at == len(x):
                return x, curve

    rng = np.random.default_rng(8)
    for trial in range(200):
        n = int(rng.integers(3, 200))
        x = (rng.uniform(0.5, 2.5) * np.sin(np.arange(n) * rng.uniform(0.01, 0.5) + rng.uniform(0, 6))).astype(f)
        carried = f(0) if trial % 2 else f(rng.uniform(-0.2, 0.2))
        got, curve = soft_clip.clip(x, carried)
        want, end = plain(list(x), carried)
        assert np.allclose(got, want, atol=1e-7) and np.isclose(curve, end, atol=1e-7)


def test_soft_clip():
    t = np.arange(960) / 48000
    loud = (1.4 * np.sin(2 * np.pi * 300 * t)).astype(np.float32)
    assert np.abs(soft_clip.clip(loud, 0.0)[0]).max() <= 1
    quiet = (0.5 * np.sin(2 * np.pi * 300 * t)).astype(np.float32)
    same, curve = soft_clip.clip(quiet, 0.0)
    assert np.array_equal(same, quiet) and curve == 0
    x = (1.3 * np.sin(2 * np.pi * 200 * np.arange(480) / 48000)).astype(np.float32)
    a, curve = soft_clip.clip(x[:200], 0.0)
    b, _ = soft_clip.clip(x[200:], curve)
    assert max(np.abs(a).max(), np.abs(b).max()) <= 1
    assert soft_clip.clip(np.empty(0, np.float32), 0.0)[1] == 0


def test_pulses():
    for n in range(1, 5):
        for k in range(5):
            every = [pvq.vector(i, n, k) for i in range(pvq.count(n, k))]
            assert len(set(map(tuple, every))) == len(every)
            assert all(sum(map(abs, v)) == k and pvq.index(v) == i for i, v in enumerate(every))
    y = pvq.search(np.array([0.9, -0.1, 0.4, 0.0]), 5)
    assert np.abs(y).sum() == 5 and y[0] > 0 and y[3] == 0
    assert np.abs(pvq.search(np.zeros(4), 3)).sum() == 3


def test_mdct_reconstructs():
    x = np.random.default_rng(1).standard_normal(32 * 9)
    frames = np.stack([x[i * 32 : i * 32 + 64] for i in range(8)])
    assert np.abs(mdct.inverse(mdct.forward(frames)) - x[32:-32]).max() < 1e-12


def test_concealment():
    silence, state = conceal.step(conceal.State(), None, 64)
    assert not silence.any()
    tone = np.sin(2 * np.pi * np.arange(512) / 32)
    _, state = conceal.step(conceal.State(), tone, 64)
    first, state = conceal.step(state, None, 64)
    second, state = conceal.step(state, None, 64)
    assert np.allclose(first, 0.99 * tone[:64], atol=1e-9) and np.abs(second).max() < np.abs(first).max()
    back, _ = conceal.step(state, tone[:64] * 2, 64)
    assert abs(back[4]) < abs(tone[4] * 2) and np.allclose(back[16:], tone[16:64] * 2)
