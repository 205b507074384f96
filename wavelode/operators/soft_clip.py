"""Soft clipping with a curve carried from frame to frame.

An excursion beyond one is bent, from the zero crossing before it to the one after it, by ``x + a x^2`` with
the smallest ``a`` that brings its peak to one.  A curve that is still open at a frame's end goes on in the
next frame up to its first zero crossing.  One state value per channel; ``clip`` is the pure step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MARGIN = np.float32(2.4e-7)


def clip(frame: np.ndarray, carried: float) -> tuple[np.ndarray, float]:
    """One channel's frame (float32) and the curve it begins under; the clipped frame and the curve it ends under."""
    x = np.clip(frame.astype(np.float32), np.float32(-2), np.float32(2))
    n, a = len(x), np.float32(carried)
    if a:
        opposite = np.flatnonzero(x * a >= 0)  # the curve holds while the signal is on its side
        stop = opposite[0] if len(opposite) else n
        x[:stop] += a * x[:stop] * x[:stop]
    at, a = 0, np.float32(0)
    first = x[0] if n else np.float32(0)
    while True:
        over = np.flatnonzero(np.abs(x[at:]) > 1)
        if not len(over):
            a = np.float32(0)
            break
        peak = at + int(over[0])
        side = x * x[peak] >= 0
        start = peak
        while start > 0 and side[start - 1]:
            start -= 1
        after = np.flatnonzero(~side[peak:])
        end = peak + int(after[0]) if len(after) else n
        top = peak + int(np.argmax(np.abs(x[peak:end])))
        height = np.abs(x[top])
        a = (height - np.float32(1)) / (height * height)
        a += a * _MARGIN
        if x[top] > 0:
            a = -a
        x[start:end] += a * x[start:end] * x[start:end]
        if start == 0 and first * x[top] >= 0 and top >= 2:
            # the excursion began before this frame: a ramp joins the old first sample to the new curve
            offset = first - x[0]
            ramp = np.full(top - at + 1, offset / np.float32(top), np.float32)
            ramp[0] = offset
            ramp = np.subtract.accumulate(ramp)[1:]  # lowered by a step before its first sample
            x[at:top] = np.clip(x[at:top] + ramp, np.float32(-1), np.float32(1))
        at = end
        if at == n:
            break
    return x, float(a)


def clip_streams(frames: DataFrame, stream: str, order: str, samples: str) -> DataFrame:
    """Clips ``array`` frames of each stream in order; a stream is read frame by frame, not held.

    Rows are dealt by stream and sorted in their partition, so the curve is one value between two rows.
    """
    schema = frames.select(stream, order, samples).withColumn(samples, frames[samples].cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, curve = None, 0.0
        for batch in batches:
            out = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != last:
                    last, curve = key, 0.0
                y, curve = clip(np.array(x.values) if x.is_valid else np.empty(0, np.float32), curve)
                out.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float32()))], names=[stream, order, samples])

    rows = frames.select(stream, order, frames[samples].cast("array<float>").alias(samples))
    return rows.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, schema)
