"""The first symbols of a frame: CELT's flags and post-filter, SILK's activity and redundancy flags."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .range_coder import Decoder

# Complements of the cumulative frequencies, of 4, for the post-filter's tap set.
TAPSET = (2, 1, 0)


def celt_header(frame: bytes, size_log: int, start_band: int = 0) -> dict:
    """Silence, post-filter, transient and intra flags; ``size_log``: 0 for 2.5 ms to 3 for 20 ms.

    Frames of at most one byte are losses: every flag is null.
    """
    out: dict = dict.fromkeys(("silence", "period", "gain_index", "tapset", "transient", "intra"))
    if len(frame) <= 1:
        return out
    d, bits = Decoder(frame), 8 * len(frame)
    used = d.tell()
    out["silence"] = bool(used >= bits or used == 1 and d.bit_logp(15))
    if out["silence"]:
        return out
    out["transient"] = out["intra"] = False
    if start_band == 0 and d.tell() + 16 <= bits and d.bit_logp(1):
        octave = d.uniform(6)[0]
        out["period"] = (16 << octave) + d.raw(4 + octave) - 1
        out["gain_index"] = d.raw(3)
        out["tapset"] = d.icdf(TAPSET, 2) if d.tell() + 2 <= bits else 0
    if size_log > 0 and d.tell() + 3 <= bits:
        out["transient"] = bool(d.bit_logp(3))
    if d.tell() + 3 <= bits:
        out["intra"] = bool(d.bit_logp(3))
    return out


def silk_flags(frame: bytes, silk_frames: int, channels: int) -> dict:
    """Voice activity of each SILK frame and whether redundancy follows, by channel."""
    d = Decoder(frame)
    active, redundant = [], []
    for _ in range(channels):
        active.append([bool(d.bit_logp(1)) for _ in range(silk_frames)])
        redundant.append(bool(d.bit_logp(1)))
    return {"active": active, "redundant": redundant}


def with_celt_headers(frames: DataFrame, data: str = "data") -> DataFrame:
    """``doc_id, frame_pos`` and the header of each CELT frame (``mode`` and ``frame_ns`` say which)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "frame_pos", "silence", "period", "gain_index", "tapset", "transient", "intra"]
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = []
            for doc, pos, ns, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc, pos, *celt_header(frame, (ns // 2_500_000).bit_length() - 1).values()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    celt = frames.where("mode = 'CELT-only'").select("doc_id", "frame_pos", "frame_ns", F.col(data))
    return celt.mapInArrow(run, "doc_id long, frame_pos int, silence boolean, period int, gain_index int, tapset int, transient boolean, intra boolean")
