"""Test-vector records, raw PCM and quality baselines.

A vector file is a chain of ``u32be length, u32be final_range, payload``; PCM is signed 16-bit little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def parse_records(data: bytes) -> Iterator[tuple[int, int | None, bytes | None, str | None]]:
    """``(record_pos, final_range, payload, error)``; a cut record is an error and the last."""
    at, k = 0, 0
    while at < len(data):
        if at + 8 > len(data):
            yield k, None, None, "short record"
            return
        size, final = struct.unpack_from(">II", data, at)
        if at + 8 + size > len(data):
            yield k, final, None, "short record"
            return
        yield k, final, data[at + 8 : at + 8 + size], None
        at, k = at + 8 + size, k + 1


def build_records(records: list[tuple[int, bytes]]) -> bytes:
    return b"".join(struct.pack(">II", len(p), r) + p for r, p in records)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(parse_records(data.as_py()))
                columns = [[name] * len(rows), *([r[i] for r in rows] for i in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["path", "record_pos", "final_range", "payload", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record_pos long, final_range long, payload binary, error string")


def s16le(samples: np.ndarray) -> bytes:
    """Float samples as PCM bytes: half away from zero, saturated."""
    x = np.asarray(samples, np.float64) * 32768
    return np.clip(np.trunc(x + np.copysign(0.5, x)), -32768, 32767).astype("<i2").tobytes()


def from_s16le(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2") / 32768


def to_pcm(frames: DataFrame, samples: str, pcm: str = "pcm") -> DataFrame:
    """Adds each frame's samples as PCM bytes."""
    schema = T.StructType([*frames.schema.fields, T.StructField(pcm, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(samples))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s16le(np.array(x.values)) if x.is_valid else None for x in column], pa.binary())], names=[*batch.schema.names, pcm])

    return frames.mapInArrow(run, schema)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``version, bitrate, signal, tier1_snr_db, tier2_wsnr_db`` of a quality baseline in JSON."""
    schema = "version int, bitrate int, signals map<string, struct<tier1SnrDb: double, tier2WsnrDb: double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    out = rows.select("version", "bitrate", F.explode("signals").alias("signal", "v"))
    return out.select("version", "bitrate", "signal", F.col("v.tier1SnrDb").alias("tier1_snr_db"), F.col("v.tier2WsnrDb").alias("tier2_wsnr_db"))


def read_corpus_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``version, bitrate, clip, weighted_error, bad_windows, total_windows`` of a corpus baseline in JSON."""
    schema = "version int, bitrate int, clips map<string, struct<weightedError: double, badWindows: int, totalWindows: int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    out = rows.select("version", "bitrate", F.explode("clips").alias("clip", "v"))
    return out.select("version", "bitrate", "clip", F.col("v.weightedError").alias("weighted_error"), F.col("v.badWindows").alias("bad_windows"), F.col("v.totalWindows").alias("total_windows"))
