"""Voice activity from four bands: energies above a tracked noise floor.

The signal is halved three times by a first-order all-pass pair, which gives bands of an eighth, an eighth, a
quarter and a half of it.  The floor follows an inverse mean that learns slowly while the signal is loud, so
speech does not raise it.  One state by stream; ``activity`` is the pure step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ALLPASS = (0.7, 0.15)
SLOW, START = 0.05, 15


@dataclass
class State:
    halves: list = field(default_factory=lambda: [np.zeros(2) for _ in range(3)])
    floor: np.ndarray = field(default_factory=lambda: np.full(4, 1e-6))
    frames: int = 0
    smooth: np.ndarray = field(default_factory=lambda: np.zeros(4))


def split(x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low and high half of a signal at half its rate."""
    even, odd = x[0::2], x[1::2]
    n = min(len(even), len(odd))
    s, t = state
    a, b = np.empty(n), np.empty(n)
    for i in range(n):
        d = (even[i] - s) * ALLPASS[0]
        a[i], s = s + d, even[i] + d
        d = (odd[i] - t) * ALLPASS[1]
        b[i], t = t + d, odd[i] + d
    return (a + b) / 2, (b - a) / 2, np.array([s, t])


def activity(frame: np.ndarray, state: State) -> tuple[float, np.ndarray, State]:
    """How probably a frame is speech, its four bands' ratios to the floor in dB, and the next state."""
    halves, bands, low = [], [], np.asarray(frame, np.float64)
    for k in range(3):
        low, high, memory = split(low, state.halves[k])
        halves.append(memory)
        bands.append(high)
    bands.append(low)
    energy = np.array([float(b @ b) / max(1, len(b)) for b in bands[::-1]]) + 1e-12
    rate = max(1 / (state.frames + START), SLOW)
    # loud bands teach the floor little
    rate = np.where(energy > 8 * state.floor, rate / 16, np.where(energy > state.floor, rate / 4, rate))
    floor = 1 / (1 / state.floor + rate * (1 / energy - 1 / state.floor))
    ratio = 10 * np.log10(np.maximum(energy / floor, 1))
    smooth = state.smooth + 0.25 * (ratio - state.smooth)
    level = float(np.sqrt(np.mean(ratio**2)))
    probability = 1 / (1 + np.exp(-(level - 8) / 2))
    return float(probability), smooth, State(halves, floor, state.frames + 1, smooth)


def activity_streams(frames: DataFrame, stream: str, order: str, samples: str) -> DataFrame:
    """``activity`` of each stream's frames in order."""
    schema = frames.select(stream, order).schema.simpleString()[7:-1].replace(":", " ") + ", activity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), State()
        for batch in batches:
            out = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != last:
                    last, state = key, State()
                if not x.is_valid:
                    out.append(None)
                    continue
                p, _, state = activity(np.array(x.values), state)
                out.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[stream, order, "activity"])

    return frames.select(stream, order, frames[samples].cast("array<double>")).repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, schema)
