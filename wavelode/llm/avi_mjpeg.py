"""AVI motion-JPEG: RIFF index parsing, intra-frame decoding, and shots by adaptive histogram differences.

Reading: ``parse_avi`` walks the RIFF chunks, takes frames from ``idx1`` (or from ``movi`` itself where
there is no index), ``decode_frame`` decodes a baseline JPEG to quantised coefficients and to samples,
``shots`` cuts where the histogram of a frame differs from the last one's by more than the running mean
and spread of such differences allow.  ``clips`` gives a row per shot with its times.

Writing: a payload is stored without loss in the format's own unit, the quantised DCT coefficient.  A
byte is the 8 extra bits of a coefficient of magnitude category 8; its Huffman code is one bit, as the
tables hold that category alone, and every block is a restart interval, so a block is 72 bytes before
stuffing.  Any baseline decoder can open the frames; frames of this kind are read here in bulk.

Null payloads count as empty.  A damaged file raises ValueError in the functions and gives a row with
``error`` in ``clips``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SIDE = 64  # samples of a stored frame's side
FRAME_BYTES = SIDE * SIDE
RATE = 25  # frames a second
BINS = 16
#: A cut needs a difference above FLOOR and above mean + SPREAD * deviation of the shot's differences so far.
FLOOR, SPREAD = 0.25, 3.0
#: Frames decoded at once.
GROUP = 64

# The order in which a JPEG block stores its coefficients.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1] + [0] * 15 + [8])  # one symbol, 8, of one bit
_HEAD = b"\xff\xd8"
_TABLES = (
    _segment(0xDB, b"\0" + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\0" + _ONE_CODE)
    + _segment(0xC4, b"\x10" + _ONE_CODE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold ``payload``, 4096 bytes each; a comment says how many bytes count."""
    frames = []
    for at in range(0, len(payload), FRAME_BYTES * GROUP):
        part = payload[at : at + FRAME_BYTES * GROUP]
        n = -(-len(part) // FRAME_BYTES)
        data = np.frombuffer(part.ljust(n * FRAME_BYTES, b"\0"), np.uint8)
        bits = np.zeros((len(data), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
        packed = np.packbits(bits.reshape(-1, 576), axis=1).tobytes()
        for f in range(n):
            blocks = [packed[b : b + 72].replace(b"\xff", b"\xff\0") for b in range(f * 4608, (f + 1) * 4608, 72)]
            scan = b"".join(x for i, b in enumerate(blocks) for x in (b, bytes((0xFF, 0xD0 + i % 8))))[:-2]
            used = min(FRAME_BYTES, len(part) - f * FRAME_BYTES)
            frames.append(_HEAD + _segment(0xFE, b"payload=%d" % used) + _TABLES + scan + b"\xff\xd9")
    return frames


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def build_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """A RIFF AVI file with an ``idx1`` index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _whole(read: Callable) -> Callable:
    """Damage of any kind is a ValueError."""

    @wraps(read)
    def run(*args):
        try:
            return read(*args)
        except (IndexError, KeyError, OverflowError, struct.error) as e:
            raise ValueError(f"damaged: {type(e).__name__} {e}") from e

    return run


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError(f"chunk {tag!r} reaches over its end")
        yield tag, at + 8, size
        at += 8 + size + size % 2


@_whole
def parse_avi(data: bytes) -> dict:
    """``frames``: places and sizes of the video chunks, by the index; ``micros`` a frame; ``indexed``."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI file")
    out = {"micros": 0, "width": 0, "height": 0, "frames": [], "indexed": False}
    movi = index = None
    for tag, at, size in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4]
        if tag == b"LIST" and kind == b"hdrl":
            for t, a, _ in _chunks(data, at + 4, at + size):
                if t == b"avih":
                    out["micros"], out["width"], out["height"] = struct.unpack_from("<I", data, a)[0], *struct.unpack_from("<II", data, a + 32)
        elif tag == b"LIST" and kind == b"movi":
            movi = (at, size)
        elif tag == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    video = re.compile(rb"\d\dd[bc]")
    if index is not None:
        entries = [(data[a : a + 4], *struct.unpack_from("<III", data, a + 4)) for a in range(index[0], index[0] + index[1] - 15, 16)]
        # offsets count from the list's kind or from the file's start
        base = movi[0] if not entries or data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        out["frames"] = [(base + off + 8, size) for tag, _, off, size in entries if video.fullmatch(tag) and base + off + 8 + size <= len(data)]
        out["indexed"] = True
    else:
        out["frames"] = [(a, s) for t, a, s in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if video.fullmatch(t)]
    return out


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


@_whole
def parse_jpeg(data: bytes) -> dict:
    """Segments of a baseline JPEG: tables, components, restart interval, comments and the scan's bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    out: dict = {"quant": {}, "huff": {}, "raw": {}, "restart": 0, "comments": []}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("JPEG segments end early")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = divmod(body[0], 16)
                n = 128 if wide else 64
                out["quant"][name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                if len(out["quant"][name]) != 64:
                    raise ValueError("a quantisation table is cut short")
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["raw"][body[0]] = body[1 : 17 + n]
                out["huff"][body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            if not (out["height"] and out["width"] and n and all(s >> 4 and s & 15 for s in body[7 : 7 + 3 * n : 3])):
                raise ValueError("a frame without samples")
            if depth != 8:
                raise ValueError("only 8-bit samples are supported")
            out["parts"] = [(body[6 + 3 * i], *divmod(body[7 + 3 * i], 16), body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG is supported")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out["comments"].append(body)
        elif marker == 0xDA:
            out["tables"] = {body[1 + 2 * i]: divmod(body[2 + 2 * i], 16) for i in range(body[0])}
            end = data.rfind(b"\xff\xd9")
            out["scan"] = data[at : end if end >= at else len(data)]
            return out


_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


def _is_bulk(j: dict) -> bool:
    return len(j["parts"]) == 1 and j["restart"] == 1 and j["raw"].get(0) == _ONE_CODE and j["raw"].get(0x10) == _ONE_CODE and j["parts"][0][1:3] == (1, 1)


def bulk_bytes(scans: list[bytes]) -> np.ndarray:
    """The extra bits of every coefficient of bulk scans, a byte each, in stored order."""
    raw = b"".join(_RESTARTS.sub(b"", s).replace(b"\xff\0", b"\xff") for s in scans)
    if len(raw) % 9:
        raise ValueError("a bulk scan is cut short")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 9)
    return np.packbits(bits[:, 1:], axis=1).ravel()


def _scan_coefficients(j: dict) -> dict[int, np.ndarray]:
    """Coefficients by component in raster order of blocks, from any baseline scan, symbol by symbol."""
    parts = j["parts"]
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        hm = vm = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = -(-j["width"] // (8 * hm)), -(-j["height"] // (8 * vm))
    # a block takes two bits at least
    if across * down * sum(p[1] * p[2] for p in parts) * 2 > 8 * len(j["scan"]) + 64:
        raise ValueError("the scan is cut short")
    out = {p[0]: np.zeros((down * p[2], across * p[1], 64), np.int64) for p in parts}
    segments = _RESTARTS.split(j["scan"])
    pending, bits, held = memoryview(b""), 0, 0
    place = 0
    last = dict.fromkeys(out, 0)

    def take(n: int) -> int:
        nonlocal bits, held, place
        while held < n:
            byte = pending[place] if place < len(pending) else 0xFF
            if place > len(pending) + 64:
                raise ValueError("the scan is cut short")
            place += 1
            bits, held = (bits << 8 | byte) & 0xFFFFFFFF, held + 8
        held -= n
        return bits >> held & (1 << n) - 1

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def value(size: int) -> int:
        v = take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for mcu in range(across * down):
        if mcu == 0 or j["restart"] and mcu % j["restart"] == 0:
            k = mcu // j["restart"] if j["restart"] else 0
            if k >= len(segments):
                raise ValueError("restart intervals are missing")
            pending, place, bits, held = memoryview(segments[k].replace(b"\xff\0", b"\xff")), 0, 0, 0
            last = dict.fromkeys(out, 0)
        y, x = divmod(mcu, across)
        for name, h, v, _ in parts:
            dc, ac = j["tables"][name]
            for b in range(h * v):
                block = out[name][y * v + b // h, x * h + b % h]
                last[name] += value(symbol(j["huff"][dc]))
                block[0] = last[name]
                i = 1
                while i < 64:
                    run, size = divmod(symbol(j["huff"][16 + ac]), 16)
                    if not size:
                        if run < 15:
                            break
                        i += 16
                        continue
                    i += run
                    if i > 63:
                        raise ValueError("a block is too long")
                    block[i] = value(size)
                    i += 1
    return out


_COS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Coefficients in stored order to samples in raster order.
_INVERSE = np.kron(_COS, _COS)[ZIGZAG].astype(np.float32)


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of blocks ``(n, 64)`` in stored order."""
    values = (coefficients * quant).astype(np.float32) @ _INVERSE
    return np.clip(np.rint(values + 128), 0, 255).astype(np.uint8)


@_whole
def decode_frame(data: bytes) -> np.ndarray:
    """The first component's samples ``(height, width)``: luminance, or grey."""
    j = parse_jpeg(data)
    name, h, v, q = j["parts"][0]
    if _is_bulk(j):
        raw = bulk_bytes([j["scan"]]).astype(np.int64)
        across = -(-j["width"] // 8)
        coefficients = np.where(raw < 128, raw - 255, raw)
        if len(raw) != across * -(-j["height"] // 8) * 64:
            raise ValueError("a bulk scan is cut short")
        coefficients = coefficients.reshape(-1, across, 64)
    else:
        coefficients = _scan_coefficients(j)[name]
    rows, across = coefficients.shape[:2]
    px = samples(coefficients.reshape(-1, 64), j["quant"][q]).reshape(rows, across, 8, 8).swapaxes(1, 2).reshape(rows * 8, across * 8)
    hm, vm = max(p[1] for p in j["parts"]), max(p[2] for p in j["parts"])
    return px[: -(-j["height"] * v // vm), : -(-j["width"] * h // hm)]


@_whole
def histograms(data: bytes, frames: list[tuple[int, int]]) -> tuple[np.ndarray, bytes]:
    """Shares of ``BINS`` levels for each frame, and the payload that its comments mark."""
    hist, payload = [], []
    for at in range(0, len(frames), GROUP):
        group = [parse_jpeg(data[a : a + n]) for a, n in frames[at : at + GROUP]]
        if all(_is_bulk(j) and (j["width"], j["height"]) == (SIDE, SIDE) for j in group):
            raw = bulk_bytes([j["scan"] for j in group])
            if len(raw) != len(group) * FRAME_BYTES:
                raise ValueError("a bulk scan is cut short")
            c = raw.astype(np.float32)
            c -= np.float32(255) * (raw < 128)
            px = samples(c.reshape(-1, 64), np.float32(group[0]["quant"][group[0]["parts"][0][3]]))
            level = (px >> 4).reshape(len(group), -1) + (np.arange(len(group)) * BINS)[:, None]
            hist.append(np.bincount(level.ravel(), minlength=len(group) * BINS).reshape(-1, BINS) / FRAME_BYTES)
            for i, j in enumerate(group):
                used = next((int(c[8:]) for c in j["comments"] if c.startswith(b"payload=")), 0)
                payload.append(raw[i * FRAME_BYTES : i * FRAME_BYTES + used].tobytes())
        else:
            for a, n in frames[at : at + GROUP]:
                px = decode_frame(data[a : a + n])
                hist.append(np.bincount((px >> 4).ravel(), minlength=BINS)[None] / max(1, px.size))
    return np.concatenate(hist) if hist else np.zeros((0, BINS)), b"".join(payload)


def shots(hist: np.ndarray) -> list[tuple[int, int, float]]:
    """``(first, end, difference at its start)`` of each shot."""
    if not len(hist):
        return []
    out, first, start, seen = [], 0, 0.0, []
    for i, d in enumerate(np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2, 1):
        limit = max(FLOOR, float(np.mean(seen) + SPREAD * np.std(seen))) if seen else FLOOR
        if d > limit:
            out.append((first, i, start))
            first, start, seen = i, float(d), []
        else:
            seen.append(float(d))
    return [*out, (first, len(hist), start)]


def store(payload: bytes) -> bytes:
    """A payload as an AVI file."""
    return build_avi(encode_frames(payload))


def restore(media: bytes) -> tuple[bytes, np.ndarray, dict]:
    """The payload that ``store`` put in, the frames' histograms, and the parsed index."""
    avi = parse_avi(media)
    hist, payload = histograms(media, avi["frames"])
    return payload, hist, avi


def clips(media: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """A row per shot of each file: ``id, clip, first_frame, frames, start_us, end_us, cut, error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "clip", "first_frame", "frames", "start_us", "end_us", "cut", "error"]
        types = [None, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        for batch in common.slices(batches, 16):
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    _, hist, avi = restore(data or b"")
                    rows += [(i, k, a, b - a, a * avi["micros"], b * avi["micros"], c, None) for k, (a, b, c) in enumerate(shots(hist))]
                except ValueError as e:
                    rows.append((i, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t or batch.schema.field(0).type) for k, t in enumerate(types)], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(media_col)).mapInArrow(run, f"id {kind}, clip int, first_frame int, frames int, start_us long, end_us long, cut double, error string")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, padded with zeros to a positive multiple of 64 bytes, reads it back and describes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in common.slices(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                media = store(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"))
                payload, hist, avi = restore(media)
                cut = shots(hist)
                means = hist @ np.arange(BINS)
                feature = f"frames={len(hist)};shots={len(cut)};spans=" + ",".join(f"{a * avi['micros'] // 1000}-{b * avi['micros'] // 1000}ms" for a, b, _ in cut) + f";level={means.mean():.3f}"
                rows.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
