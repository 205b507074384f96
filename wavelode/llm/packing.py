"""Packing in space-filling-curve order.

1. Each document is tokenised; its ids are hashed into a count vector, which fixed random signs
   project to ``DIMS`` means; their quantised place on the Hilbert curve is the document's key.
2. The keys (not the ids) are range-sorted; prefix sums over partition totals give each document the
   count of ids before it along the curve, so neighbours on the curve are packed together.
3. The curve's ids are cut every ``length`` ids.  Sequences are full; the last few ids fill
   sequences of powers of two, which need no padding.

Documents may be cut: each id is in exactly one piece.  Null text is empty: its document is its end
id alone.  Repeated rows are documents of their own; the order of equal keys is by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe, common

#: Dimensions of the curve, bits of each, and hash buckets (the top 8 bits of a product).
DIMS, BITS, BUCKETS = 4, 12, 256
_SIGNS = np.random.Generator(np.random.PCG64(20)).integers(0, 2, (BUCKETS, DIMS)) * 2 - 1


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points ``(n, dims)`` below ``2**bits``."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_points(ids: np.ndarray) -> np.ndarray:
    """A document's quantised projection; integer sums, so the same everywhere."""
    hashed = ids.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24)
    sums = np.bincount(hashed, minlength=BUCKETS) @ _SIGNS
    half = 1 << (BITS - 1)
    return np.clip(half + sums * (2 * half) // max(1, len(ids)), 0, 2 * half - 1)


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, key, ids binary)``; ids of two bytes where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        width = "<u2" if coder.n_ids <= 1 << 16 else "<u4"
        for batch in common.slices(batches, 2048):
            out, points = [], []
            for found in coder.encode_all(batch.column(1)):
                ids = np.append(found, np.uint32(end_id))
                points.append(curve_points(ids))
                out.append(ids.astype(width).tobytes())
            keys = hilbert_keys(np.array(points)) if points else []
            size = np.dtype(width).itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // size for x in out], pa.int64()), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "key", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(common.tidy(run), "doc_id long, n long, key long, ids binary")


def boundaries_after(total: int, length: int) -> list[int]:
    """Where sequences start past the full ones, with the end: powers of two, largest first."""
    at, rest, out = total - total % length, total % length, []
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return [*out, total]


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and the piece's ``ids``."""
    tokens = common.stage(tokenized(docs, path, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pack-ids", "zstd")
    order, _, total = common.global_prefix(tokens.select("key", "doc_id", "uid", "n"), ["key", "doc_id", "uid"], "n", "pack-order")
    tail = np.array(boundaries_after(total, length), np.int64)
    full = total // length
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
        for batch in common.slices(batches):
            cols: list[list] = [[] for _ in names]
            for doc, n, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")
                first, last = at // length, (at + n - 1) // length
                cuts = [at, *range((first + 1) * length, min(last + 1, full + 1) * length, length)]
                cuts = [c for c in cuts if c < at + n] + [int(t) for t in tail if max(at, full * length) < t < at + n]
                cuts = sorted({*cuts, at + n})
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = ids[a - at : b - at]
                    if a < full * length:
                        seq, off = divmod(a, length)
                    else:
                        j = int(np.searchsorted(tail, a, side="right")) - 1
                        seq, off = full + j, a - int(tail[j])
                    row = [doc, a - at, b - a, zlib.crc32(part.tobytes()), n, seq, off] + [part.astype(np.int32)] * keep_ids
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    placed = tokens.select("uid", "doc_id", "n", "ids").join(order.select("uid", "weight_at"), "uid")
    return placed.select("doc_id", "n", "weight_at", "ids").mapInArrow(common.tidy(run), schema)
