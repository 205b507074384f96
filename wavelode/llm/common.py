"""What the operators of this folder share: the shared work folder, staged tables, prefix sums, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

#: Rows of a batch that are turned into Python objects at once; long texts thus stay few in memory.
SLICE_ROWS = 256


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset and the master is local."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="wavelode-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return f"{conf.rstrip('/')}/wavelode"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: Spark keeps workers for later tasks, and their allocators keep what a task freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
            if trim:
                trim(0)

    return wrapped


def whole_strings(texts: pa.Array) -> pa.Array:
    """The texts as an array of its own, nulls as empty: string kernels misread slices that were cast."""
    own = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(own, "").cast(pa.large_string())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_prefix(df: DataFrame, order: list[str], weight: str, name: str) -> tuple[DataFrame, int, int]:
    """Rows in the global order of ``order`` with ``row_at`` and ``weight_at``, the rows and weight before each.

    A range partitioning sorts the rows; each partition sums its own, a table of one total per
    partition gives the offsets.  ``df`` must be narrow; ``order`` should tell rows apart, so that
    no key fills a partition.  Returns the staged table, its row count and its total weight.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ranged.withColumn("part", F.lit(0)).withColumn("row_in", F.lit(0).cast("long")).withColumn("weight_in", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = np.asarray(batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = total + np.cumsum(w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int64)), pa.array(ends - w)], names=schema.names)
            row, total = row + n, int(ends[-1])

    local = stage(ranged.mapInArrow(tidy(run), schema), name)
    totals = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).orderBy("part").collect()  # a row per partition
    before, rows, weights = [], 0, 0
    for t in totals:
        before.append((t["part"], rows, weights))
        rows, weights = rows + t["n"], weights + t["w"]
    if not before:
        return local.withColumn("row_at", F.col("row_in")).withColumn("weight_at", F.col("weight_in")).drop("part", "row_in", "weight_in"), 0, 0
    offsets = spark.createDataFrame(before, "part int, row_before long, weight_before long")
    out = local.join(F.broadcast(offsets), "part").withColumn("row_at", F.col("row_before") + F.col("row_in")).withColumn("weight_at", F.col("weight_before") + F.col("weight_in"))
    out = out.drop("part", "row_in", "weight_in", "row_before", "weight_before")
    out.staged_path = local.staged_path
    return out, rows, weights


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges (a long, b long)``: ``(id, comp)``, comp being the smallest id.

    Alternating large-star and small-star rounds; each is an aggregation, so a node of any
    degree is met by partial minima, and every round ends in a staged table.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small, name)
        sums = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(now)
        now = new
        if sums == last:
            break
        last = sums
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    both = out.union(roots)
    both.staged_path = now.staged_path
    return both
