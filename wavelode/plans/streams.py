"""Queries over ordered streams: gaps, losses, sessions, and reassembly by lacing, with finite or running windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ship

#: Seconds without an event that make a loss, and seconds that end a session.
LOSS_S, SESSION_S = 7200, 14400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def q33_loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per gap, with how many whole periods of ``LOSS_S`` it spans."""
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    y = events(spark, sf_dir).withColumn("gap", micros - F.lag(micros).over(_by_user()))
    return y.where(F.col("gap") > LOSS_S * 1_000_000).select("event_id", "user_id", F.floor(F.col("gap") / (LOSS_S * 1_000_000)).alias("n_lost"))


def q34_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events that are less than ``SESSION_S`` apart."""
    y = events(spark, sf_dir).where("ts IS NOT NULL").groupBy("user_id", F.session_window("ts", f"{SESSION_S} seconds").alias("w"))
    return y.agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("value"), F.min("event_id").alias("first_event")).drop("w")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments of 256 streams: ``n_chars % 256`` is a segment's lacing value."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.pmod("doc_id", F.lit(256)).alias("stream"), F.pmod("n_chars", F.lit(256)).cast("int").alias("lacing"))


def _by_stream():
    return Window.partitionBy("stream").orderBy("doc_id")


def q35_lacing_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment below 255 ends a packet: its number is the count of ends before it."""
    before = F.coalesce(F.sum((F.col("lacing") < 255).cast("int")).over(_by_stream().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    y = _documents(spark, sf_dir).withColumn("packet", before)
    return y.groupBy("stream", "packet").agg(F.sum("lacing").alias("n_bytes"), F.count(F.lit(1)).alias("n_segments"), F.bool_or(F.col("lacing") < 255).alias("complete"))


def q36_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose number does not follow the last one's within the stream; a lacing of 0 is an empty page, which does not count."""
    y = _documents(spark, sf_dir).where("lacing > 0").withColumn("last_id", F.lag("doc_id").over(_by_stream()))
    return y.where(F.col("doc_id") != F.col("last_id") + 256).select("stream", "doc_id", ((F.col("doc_id") - F.col("last_id")) / 256 - 1).cast("long").alias("n_missing"))


def q37_late_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user before the first signup are discarded: a running maximum of the boundary."""
    joined = F.max((F.col("event_type") == "signup").cast("int")).over(_by_user().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    y = events(spark, sf_dir).withColumn("joined", joined)
    return y.groupBy("user_id").agg(F.count_if(F.col("joined") == 0).alias("n_discarded"), F.count_if(F.col("joined") == 1).alias("n_kept"))


_BY = "(PARTITION BY user_id ORDER BY ts, event_id)"
_DOCS = "d AS (SELECT doc_id, doc_id % 256 AS stream, CAST(n_chars % 256 AS INTEGER) AS lacing FROM documents)"
ORACLE = {
    "q33_loss_rows": f"WITH g AS (SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER {_BY}) AS gap FROM events) SELECT event_id, user_id, gap // {LOSS_S * 1_000_000} AS n_lost FROM g WHERE gap > {LOSS_S * 1_000_000}",
    "q34_sessions": f"WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= {SESSION_S * 1_000_000}, true) AS fresh FROM events WHERE ts IS NOT NULL), n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS value, min(event_id) AS first_event FROM n GROUP BY user_id, k",
    "q35_lacing_reassembly": f"WITH {_DOCS}, p AS (SELECT *, CAST(coalesce(sum(CASE WHEN lacing < 255 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS packet FROM d) SELECT stream, packet, CAST(sum(lacing) AS BIGINT) AS n_bytes, count(*) AS n_segments, bool_or(lacing < 255) AS complete FROM p GROUP BY 1, 2",
    "q36_sequence_gaps": f"WITH {_DOCS}, l AS (SELECT *, lag(doc_id) OVER (PARTITION BY stream ORDER BY doc_id) AS last_id FROM d WHERE lacing > 0) SELECT stream, doc_id, (doc_id - last_id) // 256 - 1 AS n_missing FROM l WHERE doc_id <> last_id + 256",
    "q37_late_join": f"WITH j AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER {_BY[:-1]} ROWS UNBOUNDED PRECEDING) AS joined FROM events) SELECT user_id, count(*) FILTER (joined = 0) AS n_discarded, count(*) FILTER (joined = 1) AS n_kept FROM j GROUP BY 1",
}
