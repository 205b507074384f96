"""Queries over the signal kernels: Python runs only where a computation is sequential or bit-exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import framing
from ..functions.crc import ogg_crc
from ..operators import conceal, mdct, pvq, side_info, soft_clip
from ..operators.range_coder import Decoder, Encoder
from ..session import ship
from ..sources import ogg
from .packets import packets
from .samples import frames


def q39_ogg_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def crc(data: pd.Series) -> pd.Series:
        return data.map(ogg_crc)

    return packets(spark, sf_dir).select("doc_id", crc("payload").alias("crc"))


def q40_soft_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames five times too loud, clipped with the curve carried through each stream."""
    loud = frames(spark, sf_dir).withColumn("x", F.transform("x", lambda v: (v * 5).cast("float")))
    out = soft_clip.clip_streams(loud, "label", "vec_id", "x")
    return out.select("label", "vec_id", F.round(F.array_max("x").cast("double"), 5).alias("high"), F.round(F.array_min("x").cast("double"), 5).alias("low"))


def q41_concealment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh frame is lost and concealed."""
    lossy = frames(spark, sf_dir).withColumn("x", F.when(F.col("vec_id") % 7 != 3, F.col("x")))
    out = conceal.conceal_streams(lossy, "label", "vec_id", "x", 64)
    return out.groupBy("label", "lost").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.sqrt(F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / 64)), 6).alias("rms"))


def q42_pvq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's bands of 16 samples as 8 pulses: their index, and how well they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.array(x.values)
                for band, x in enumerate(np.split(whole, range(16, len(whole), 16))):
                    y = pvq.search(x, 8)
                    number = pvq.index(y.tolist())
                    rows.append((i, band, number, int(np.abs(y).sum()), round(float(x @ pvq.unit(y) / (np.linalg.norm(x) or 1)), 6), pvq.vector(number, len(y), 8) == y.tolist()))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["vec_id", "band", "pulse_index", "pulses", "fit", "decoded"])

    return frames(spark, sf_dir).select("vec_id", "x").mapInArrow(run, "vec_id long, band int, pulse_index long, pulses long, fit double, decoded boolean")


def q43_mdct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 coefficients of each frame of 64 samples, windowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, 64)
            c = mdct.forward(x)
            flat = pa.array(np.repeat(np.array(batch.column(0)), 32), pa.int64())
            yield pa.RecordBatch.from_arrays([flat, pa.array(np.tile(np.arange(32, dtype=np.int32), len(x))), pa.array(c.ravel())], names=["vec_id", "k", "c"])

    out = frames(spark, sf_dir).where("size(x) = 64").select("vec_id", "x").mapInArrow(run, "vec_id long, k int, c double")
    return out.select("vec_id", "k", F.round("c", 6).alias("coefficient"))


def q44_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of every text coded as a number below 256 and a bit for whether it is a letter, and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for data in batch.column(1).to_pylist():
                coder = Encoder()
                for b in data:
                    coder.uniform(b, 256)
                    coder.bit_logp(b >= 128, 3)
                used = coder.tell()
                back = Decoder(coder.finish())
                same.append(all(back.uniform(256)[0] == b and back.bit_logp(3) == (b >= 128) for b in data) and back.tell() == used)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same)], names=["doc_id", "same"])

    return packets(spark, sf_dir).mapInArrow(run, "doc_id long, same boolean")


def q46_ogg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents muxed into Ogg streams of at most 64 packets, parsed to pages, and reassembled to packets."""

    def mux(rows: pa.Table) -> pa.Table:
        order = rows.sort_by("doc_id")
        data = ogg.build_stream(order.column("stream")[0].as_py() % 2**32, [p or b"" for p in order.column("payload").to_pylist()])
        return pa.table([pa.array([str(order.column("stream")[0].as_py())]), pa.array([data], pa.binary())], names=["path", "content"])

    docs = packets(spark, sf_dir).where("doc_id IS NOT NULL").withColumn("stream", F.floor(F.col("doc_id") / 64))
    files = docs.groupBy("stream").applyInArrow(mux, "path string, content binary")
    out = ogg.packets(ogg.pages_of(files))
    return out.where("error IS NULL").select((F.col("path").cast("long") * 64 + F.col("packet_pos")).alias("doc_id"), F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"))


def q47_celt_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbols of every CELT frame, taken from the valid packets."""
    return side_info.with_celt_headers(framing.frames(framing.parse(packets(spark, sf_dir))))


_W = f"CAST([{', '.join(repr(float(v)) for v in mdct.window(32))}] AS DOUBLE[])"
ORACLE = {
    "q43_mdct": f"WITH f AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, {_W} AS w FROM embeddings WHERE len(embedding) = 64) SELECT vec_id, CAST(k AS INTEGER) AS k, round(list_sum(list_transform(range(1, 65), lambda t: x[t] * w[t] * cos(pi() / 32 * (t - 1 + 0.5 + 16) * (k + 0.5)))), 6) AS coefficient FROM f, range(0, 32) r(k)",
    "q44_range_coder": "SELECT doc_id, true AS same FROM documents",
    "q46_ogg_round_trip": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha1(encode(coalesce(text, ''))) AS sha1 FROM documents WHERE doc_id IS NOT NULL",
}
