"""The fixed-point resampler of decoded speech: 8, 12 or 16 kHz to any output rate, one channel, with carried state.

Three kinds of step: two all-pass chains double the rate; a polyphase filter interpolates the doubled signal;
a second-order recursion and a symmetric filter lower the rate.  Recursions run sample by sample, filters
as array products; every product is taken over 2**16 by itself, as the format's arithmetic has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Input samples of delay by input rate (8, 12, 16 kHz) and output rate (8, 12, 16, 24, 48 kHz).
RATES_IN, RATES_OUT = (8000, 12000, 16000), (8000, 12000, 16000, 24000, 48000)
DELAYS = ((4, 0, 2, 0, 0), (0, 9, 4, 7, 4), (0, 3, 12, 7, 7))
# Coefficients of the two all-pass chains; the third of each is taken as one plus itself.
ALLPASS = ((1746, 14986, -26453), (6854, 25769, -9994))
# By (up, down) of the ratio, the recursion's two coefficients and the filter's half, by phase.
LOWER = {
    (3, 4): ((-20694, -13867), ((-49, 64, 17, -157, 353, -496, 163, 11047, 22205), (-39, 6, 91, -170, 186, 23, -896, 6336, 19928), (-19, -36, 102, -89, -24, 328, -951, 2568, 15909))),
    (2, 3): ((-14457, -14019), ((64, 128, -122, 36, 310, -768, 584, 9267, 17733), (12, 128, 18, -142, 288, -117, -865, 4123, 14459))),
    (1, 2): ((616, -14323), ((-10, 39, 58, -46, -84, 120, 184, -315, -541, 1284, 5380, 9024),)),
}
# Half of each of the twelve phases of the interpolation filter.
PHASES = np.array([(189, -600, 617, 30567), (117, -159, -1070, 29704), (52, 221, -2392, 28276), (-4, 529, -3350, 26341), (-48, 758, -3956, 23973), (-80, 905, -4235, 21254), (-99, 972, -4222, 18278), (-107, 967, -3957, 15143), (-103, 896, -3487, 11950), (-91, 773, -2865, 8798), (-71, 611, -2143, 5784), (-46, 425, -1375, 2996)], np.int64)

BATCH_MS = 10


def _sat16(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -32768, 32767)


def _rounded(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x >> (bits - 1)) + 1) >> 1


class Resampler:
    """``step`` takes a frame of whole milliseconds in [-1, 1] and gives it at the new rate."""

    def __init__(self, rate_in: int, rate_out: int) -> None:
        if rate_in not in RATES_IN or rate_out not in RATES_OUT:
            raise ValueError(f"no resampling from {rate_in} to {rate_out} Hz")
        self.k_in, self.k_out = rate_in // 1000, rate_out // 1000
        self.delay = DELAYS[RATES_IN.index(rate_in)][RATES_OUT.index(rate_out)]
        self.late = np.zeros(self.delay, np.int64)
        doubled = rate_out > rate_in and rate_out != 2 * rate_in
        # input samples per output sample in Q16, rounded up until no output is missed
        self.stride = (rate_in << 14 + doubled) // rate_out << 2
        while self.stride * rate_out >> 16 < rate_in << doubled:
            self.stride += 1
        self.chains = [[0, 0, 0], [0, 0, 0]]
        if rate_out < rate_in:
            g = np.gcd(rate_in, rate_out)
            self.recursion, phases = LOWER[rate_out // g, rate_in // g]
            self.taps = np.array(phases, np.int64)
            self.memory, self.past = [0, 0], np.zeros(2 * self.taps.shape[1], np.int64)
            self.convert = self._lower
        elif rate_out == rate_in:
            self.convert = lambda x: x
        elif rate_out == 2 * rate_in:
            self.convert = self._double
        else:
            self.past = np.zeros(8, np.int64)
            self.convert = self._interpolate

    def _double(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 2), np.int64)
        for side, (coefficients, state) in enumerate(zip(ALLPASS, self.chains, strict=True)):
            a, b, c = coefficients
            s, t, u = state
            for i, v in enumerate((x << 10).tolist()):
                d = (v - s) * a >> 16
                y, s = s + d, v + d
                d = (y - t) * b >> 16
                z, t = t + d, y + d
                d = (z - u) + ((z - u) * c >> 16)
                out[i, side], u = u + d, z + d
            self.chains[side] = [s, t, u]
        return _sat16(_rounded(out, 10)).ravel()

    def _interpolate(self, x: np.ndarray) -> np.ndarray:
        signal = np.r_[self.past, self._double(x)]
        places = np.arange(0, len(x) << 17, self.stride, dtype=np.int64)
        phase = (places & 0xFFFF) * 12 >> 16
        near = np.lib.stride_tricks.sliding_window_view(signal, 8)[places >> 16]
        weights = np.concatenate([PHASES[phase], PHASES[11 - phase][:, ::-1]], axis=1)
        self.past = signal[-8:]
        return _sat16(_rounded((near * weights).sum(axis=1), 15))

    def _lower(self, x: np.ndarray) -> np.ndarray:
        a, b = self.recursion
        s, t = self.memory
        fresh = []
        for v in x.tolist():
            y = s + (v << 8)
            fresh.append(y)
            y = (y << 2) + (1 << 31) & 0xFFFFFFFF
            y -= 1 << 31
            s, t = t + (y * a >> 16), y * b >> 16
        self.memory = [s, t]
        signal = np.r_[self.past, np.array(fresh, np.int64)]
        phases, half = self.taps.shape
        places = np.arange(0, len(x) << 16, self.stride, dtype=np.int64)
        near = np.lib.stride_tricks.sliding_window_view(signal, 2 * half)[places >> 16]
        if phases > 1:
            phase = (places & 0xFFFF) * phases >> 16
            weights = np.concatenate([self.taps[phase], self.taps[phases - 1 - phase][:, ::-1]], axis=1)
            sums = (near * weights >> 16).sum(axis=1)
        else:
            sums = ((near[:, :half] + near[:, : half - 1 : -1]) * self.taps[0] >> 16).sum(axis=1)
        self.past = signal[len(x) :]
        return _sat16(_rounded(sums, 6))

    def step(self, frame: np.ndarray) -> np.ndarray:
        n = len(frame)
        if n < self.k_in or n * self.k_out % self.k_in:
            raise ValueError("a frame must be at least a millisecond, of a whole number of output samples")
        x = np.asarray(frame, np.float64) * 32768
        x = _sat16(np.trunc(x + np.copysign(0.5, x)).astype(np.int64))
        delayed = np.r_[self.late, x[: n - self.delay]]
        self.late = x[n - self.delay :]
        # the first millisecond goes alone, the rest in batches: positions restart in each
        cuts = [0, *range(self.k_in, n, self.k_in * BATCH_MS), n]
        parts = [self.convert(delayed[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return np.concatenate(parts)[: n * self.k_out // self.k_in] / 32768


def resample_streams(frames: DataFrame, stream: str, order: str, samples: str, rate_in: int, rate_out: int) -> DataFrame:
    """Resamples the frames of each stream in order; null frames stay null and do not touch the state."""
    schema = frames.select(stream, order).schema.simpleString()[7:-1].replace(":", " ") + f", {samples} array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != last:
                    last, state = key, Resampler(rate_in, rate_out)
                out.append(state.step(np.array(x.values)) if x.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=[stream, order, samples])

    return frames.select(stream, order, frames[samples].cast("array<double>")).repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, schema)
