import random

import pytest
from pyspark.sql import functions as F

from wavelode.functions import framing, toc


def T(code):
    return bytes([0x48 | code])


CASES = [
    (T(0) + bytes(1276), "R2"),
    (T(1) + bytes(2552), "R2"),
    (T(1) + b"\0", "R3"),
    (T(2), "R4"),
    (T(2) + bytes([3, 0xAA, 0xBB]), "R4"),
    (T(3) + b"\0", "R5"),
    (T(3) + b"\7", "R5"),
    (T(3) + bytes([0x41, 5]), "R6"),
    (T(3) + bytes([0x41, 0xFF, 0]), "R6"),
    (T(3) + bytes([2, 0xAA]), "R6"),
    (T(3) + bytes([0x82, 3]), "R7"),
    (T(1) + bytes([1, 2, 3, 4]), [b"\1\2", b"\3\4"]),
    (T(2) + b"\xfc", "R4"),
    (T(2) + b"\0", [b"", b""]),
    (T(3) + b"\1", [b""]),
    (T(3) + bytes([0x41, 0xFF, 0, 0xAA]) + bytes(254), [b"\xaa"]),
    (T(3) + bytes([0x82, 0]) + bytes(1276), "R2"),
    (b"", "R1"),
]


def oracle(p):
    """The rules written as a loop over the bytes."""
    if not p:
        return "R1"
    config, code = p[0] >> 3, p[0] & 3
    ns = toc.configuration(config)[2]
    length = lambda q: (None, 0) if not q or q[0] >= 252 and len(q) < 2 else (q[0], 1) if q[0] < 252 else (q[0] + 4 * q[1], 2)
    body = p[1:]
    if code == 0:
        out = [body]
    elif code == 1:
        if len(body) % 2:
            return "R3"
        out = [body[: len(body) // 2], body[len(body) // 2 :]]
    elif code == 2:
        n, used = length(body)
        if n is None or used + n > len(body):
            return "R4"
        out = [body[used : used + n], body[used + n :]]
    else:
        if not body or not body[0] & 63 or (body[0] & 63) * ns > 120_000_000:
            return "R5"
        m, at = body[0] & 63, 1
        pad = 0
        if body[0] & 64:
            while True:
                if at >= len(body):
                    return "R6"
                b, at = body[at], at + 1
                pad += 254 if b == 255 else b
                if b != 255:
                    break
            if at > len(body) - pad:
                return "R6"
        rest = body[at : len(body) - pad]
        if not body[0] & 128:
            if len(rest) % m:
                return "R6"
            n = len(rest) // m
            out = [rest[i * n : (i + 1) * n] for i in range(m)]
        else:
            sizes = []
            for _ in range(m - 1):
                n, used = length(rest)
                if n is None:
                    return "R7"
                sizes.append(n)
                rest = rest[used:]
            if sum(sizes) > len(rest):
                return "R7"
            out = []
            for n in sizes:
                out.append(rest[:n])
                rest = rest[n:]
            out.append(rest)
    return "R2" if any(len(f) > 1275 for f in out) else out


def run(spark, packets):
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(packets)], "i int, payload binary")
    parsed = framing.parse(rows).cache()
    out = {r.i: r.error for r in parsed.select("i", "error").collect()}
    found = {}
    for r in framing.frames(parsed).select("i", "frame_pos", "data").orderBy("i", "frame_pos").collect():
        found.setdefault(r.i, []).append(bytes(r.data))
    parsed.unpersist()
    return [out[i] or found[i] for i in range(len(packets))]


def test_cases(spark):
    assert run(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_random_bytes(spark):
    rng = random.Random(3)
    packets = []
    for _ in range(600):
        n = rng.choice([0, 1, 2, 3, 5, 9, 40, 300, 1300])
        head = bytes([rng.randrange(256), rng.choice([1, 2, 3, 0x41, 0x42, 0x82, 0x83, 0xC2, rng.randrange(256)]), rng.choice([255, 0, 1, 252, 253, rng.randrange(256)])])
        packets.append((head + bytes(rng.choice([0, 1, 252, 255, rng.randrange(256)]) for _ in range(n)))[:n])
    assert run(spark, packets) == [oracle(p) for p in packets]


@pytest.mark.parametrize("config,mode,bandwidth,ms", [(0, "Silk-only", "Narrowband", 10), (1, "Silk-only", "Narrowband", 20), (4, "Silk-only", "Mediumband", 10), (8, "Silk-only", "Wideband", 10), (11, "Silk-only", "Wideband", 60), (12, "Hybrid", "Superwideband", 10), (14, "Hybrid", "Fullband", 10), (16, "CELT-only", "Narrowband", 2.5), (17, "CELT-only", "Narrowband", 5), (20, "CELT-only", "Wideband", 2.5), (24, "CELT-only", "Superwideband", 2.5), (28, "CELT-only", "Fullband", 2.5)])
def test_configurations(config, mode, bandwidth, ms):
    assert toc.configuration(config)[:3] == (mode, bandwidth, int(ms * 1e6))
    assert toc.configuration(32) is None


def test_toc_byte_round_trip(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("b"))
    back = toc.toc_byte(toc.config_of(F.col("b")), toc.is_stereo(F.col("b")), toc.frame_code(F.col("b")))
    assert rows.where(back != F.col("b")).count() == 0
