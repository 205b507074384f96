import random

import numpy as np
import pytest

from wavelode.operators import filters, laplace, side_info
from wavelode.operators.range_coder import Decoder, Encoder


def test_laplace_round_trip():
    rng = random.Random(9)
    for _ in range(200):
        zero, decay = rng.randrange(1, 30000), rng.randrange(1, 16000)
        coder, said = Encoder(), []
        for _ in range(20):
            said.append(laplace.encode(coder, rng.choice([0, 1, -1, 2, -3, 10, -40, 1000]), zero, decay))
        back = Decoder(coder.finish())
        assert [laplace.decode(back, zero, decay) for _ in said] == said


@pytest.mark.parametrize("zero,decay", [(9216, 8128), (30000, 100), (1000, 15000)])
def test_laplace_fills_the_scale(zero, decay):
    cells = {laplace.interval(v, zero, decay)[:2] for v in range(-3000, 3001)}
    cells = sorted(cells)
    assert cells[0][0] == 0 and cells[-1][1] == laplace.SCALE
    assert all(a[1] == b[0] for a, b in zip(cells, cells[1:], strict=False))


def test_celt_header():
    coder = Encoder()
    coder.bit_logp(0, 15)
    coder.bit_logp(1, 1)
    coder.uniform(2, 6)
    coder.raw(33, 6)
    coder.raw(5, 3)
    coder.icdf(1, side_info.TAPSET, 2)
    coder.bit_logp(1, 3)
    coder.bit_logp(0, 3)
    h = side_info.celt_header(coder.finish(40), 3)
    assert h == {"silence": False, "period": 64 + 33 - 1, "gain_index": 5, "tapset": 1, "transient": True, "intra": False}
    assert side_info.celt_header(b"\0", 3)["silence"] is None
    coder = Encoder()
    coder.bit_logp(1, 15)
    assert side_info.celt_header(coder.finish(10), 3)["silence"] is True


def test_silk_flags():
    coder = Encoder()
    for bit in (1, 0, 1, 0, 1, 1, 0, 1):
        coder.bit_logp(bit, 1)
    assert side_info.silk_flags(coder.finish(8), 3, 2) == {"active": [[True, False, True], [True, True, False]], "redundant": [False, True]}


def test_comb_pair():
    x = np.random.default_rng(1).standard_normal(600)
    past = np.zeros(300)
    made = filters.comb(x, past, (100, 0.0, 0), (100, -0.5, 0), recursive=False)
    back = filters.comb(made, past, (100, 0.0, 0), (100, 0.5, 0), recursive=True)
    assert np.abs(back - x).max() < 1e-9
    assert np.array_equal(filters.comb(x, past, (100, 0, 0), (100, 0, 0), True), x)


def test_prediction():
    rng = np.random.default_rng(2)
    a = np.array([1.2, -0.6, 0.1])
    x = filters.synthesise(rng.standard_normal(8000), a, np.zeros(3))
    for found in (filters.levinson(filters.autocorrelation(x, 3))[0], filters.burg(x, 3)[0]):
        assert np.abs(found - a).max() < 0.05
    _, k, _ = filters.levinson(filters.autocorrelation(x, 3))
    assert np.allclose(filters.step_up(k), filters.levinson(filters.autocorrelation(x, 3))[0])
    r = filters.predict_residual(x, a)
    assert np.allclose(filters.synthesise(r, a, x[:3]), x[3:])


def test_stabilise():
    rng = np.random.default_rng(3)
    gaps = np.array([250, 3, 6, 3, 3, 3, 4, 3, 3, 3, 461])
    for _ in range(200):
        x = filters.stabilise(rng.integers(-500, 34000, 10), gaps)
        assert (np.diff(np.r_[0, x, 32768]) >= gaps).all()
    calm = np.arange(1, 11) * 2900
    assert np.array_equal(filters.stabilise(calm, gaps), calm)


def test_rotation_and_order():
    x = np.random.default_rng(4).standard_normal(24)
    y = filters.rotate(x, 3, 2)
    assert np.isclose(np.linalg.norm(y), np.linalg.norm(x)) and not np.allclose(x, y)
    assert np.allclose(filters.rotate(y, 3, 2, inverse=True), x)
    assert np.array_equal(filters.rotate(x, 12, 2), x) and np.array_equal(filters.rotate(x, 3, 0), x)
    assert filters.hadamard(np.arange(6), 2).tolist() == [0, 2, 4, 1, 3, 5]


def test_tf_path():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(30):
        cost = rng.random((8, 2))
        total = lambda p: sum(cost[i, v] for i, v in enumerate(p)) + 0.3 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert np.isclose(total(filters.tf_path(cost, 0.3)), min(map(total, itertools.product((0, 1), repeat=8))))


def test_reservoir():
    r = filters.Reservoir()
    # rate 1000; alpha is 1/21, 1/22, 1/23: drift 4, then 4 + int(-104 / 22 + 4 / 22) = 0, then int(200 / 23) = 8
    assert [r.frame(1000, w, g) for w, g in ((1100, 1088), (900, 896), (1200, 640))] == [0, 0, 5]
    assert (r.reserve, r.drift, r.offset) == (0, 8, -8)
    free = filters.Reservoir(constrained=False)
    assert free.frame(1000, 5000, 64) == 0 and (free.count, free.drift) == (1, 0)


def test_rotation_of_blocks():
    # one block of eight: pairs at distance one, then at distance three (1 * 2 < 8, 2 * 3 < 8, 3 * 4 >= 8)
    x = np.array([1.0, 0, 0, 0, 0, 0, 0, 0])
    gain = 8 / (8 + 10 * 2)
    c, s = np.cos(np.pi / 4 * gain**2), np.sin(np.pi / 4 * gain**2)

    def pair(i, j, c, s):
        m = np.eye(8)
        m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
        return m

    want = x
    for d, cc, ss in ((1, c, -s), (3, s, -c)):
        for i in [*range(8 - d), *range(8 - 2 * d - 1, -1, -1)]:
            want = pair(i, i + d, cc, ss) @ want
    assert np.allclose(filters.rotate(x, 2, 2), want)
    rng = np.random.default_rng(3)
    for n, blocks in ((8, 1), (16, 2), (48, 4), (176, 8), (6, 1), (12, 4)):
        x = rng.normal(size=n)
        y = filters.rotate(x, 2, 1, blocks=blocks)
        assert np.isclose(x @ x, y @ y) and not np.allclose(x, y) and np.allclose(filters.rotate(y, 2, 1, inverse=True, blocks=blocks), x)
        # blocks do not mix
        one = filters.rotate(np.r_[x[: n // blocks], np.zeros(n - n // blocks)], 2, 1, blocks=blocks)
        assert np.allclose(one[: n // blocks], y[: n // blocks]) and not one[n // blocks :].any()


def test_stereo_unmix_ramp():
    # weights go from 0 to 1 over four samples, the first of them still under the old weight
    mid, side = np.full(8, 0.25), np.zeros(8)
    left, right = filters.stereo_unmix(mid, side, (0.0, 1.0), (0.0, 0.0), 4)
    assert np.allclose(left, 0.25 + 0.25 * np.array([0, 1, 2, 3, 4, 4]) / 4) and np.allclose(right, 0.25 - 0.25 * np.array([0, 1, 2, 3, 4, 4]) / 4)
