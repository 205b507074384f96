"""Packet loss concealment by repetition: the pure step and its ordered wrapper.

A lost frame repeats the last pitch period of what was played, each frame quieter: by 0.99 then 0.95
where the signal is periodic, by 0.99 then 0.9 where it is not; nothing played yet is silence.  A frame that
comes after a loss rises over its first quarter from the energy of the concealment to its own, if louder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HISTORY = 512
VOICED, UNVOICED = (0.99, 0.95), (0.99, 0.9)


@dataclass
class State:
    history: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lost: int = 0
    energy: float = 0.0


def pitch(history: np.ndarray, low: int = 16, high: int = 256) -> tuple[int, float]:
    """The lag of the largest normalised correlation, the first of equals, and that correlation."""
    n = len(history)
    best = (low, 0.0)
    for lag in range(low, min(high, n // 2) + 1):
        a, b = history[n - lag :], history[n - 2 * lag : n - lag]
        scale = float(np.sqrt((a @ a) * (b @ b)))
        r = float(a @ b) / scale if scale else 0.0
        if r > best[1] + 1e-12:
            best = (lag, r)
    return best


def step(state: State, frame: np.ndarray | None, size: int) -> tuple[np.ndarray, State]:
    """The next frame as played; ``frame`` None: it was lost, and has ``size`` samples."""
    if frame is None:
        if not len(state.history):
            return np.zeros(size), State(state.history, state.lost + 1, 0.0)
        lag, r = pitch(state.history)
        period = state.history[-min(lag, len(state.history)) :]
        fade = (VOICED if r > 0.5 else UNVOICED)[min(state.lost, 1)]
        out = np.resize(period, size) * fade
        return out, State(np.r_[state.history, out][-HISTORY:], state.lost + 1, float(out @ out) / max(1, size))
    out = np.array(frame, float)
    if state.lost and len(out):
        own = float(out @ out) / len(out)
        if own > state.energy:
            quarter = max(1, len(out) // 4)
            start = np.sqrt(state.energy / own)
            out[:quarter] *= start + (1 - start) * np.arange(quarter) / quarter
    return out, State(np.r_[state.history, out][-HISTORY:], 0, 0.0)


def conceal_streams(frames: DataFrame, stream: str, order: str, samples: str, size: int) -> DataFrame:
    """Plays the frames of each stream in order; null samples are losses.  Adds ``lost``."""
    schema = frames.select(stream, order).schema.simpleString()[7:-1].replace(":", " ") + f", {samples} array<double>, lost boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, State()
        for batch in batches:
            out, lost = [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != last:
                    last, state = key, State()
                y, state = step(state, np.array(x.values) if x.is_valid else None, size)
                out.append(y)
                lost.append(not x.is_valid)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64())), pa.array(lost)], names=[stream, order, samples, "lost"])

    return frames.select(stream, order, frames[samples].cast("array<double>")).repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, schema)
