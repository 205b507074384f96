"""The driver's queries over this folder's operators: one thin ``opN_*`` each, with the contract's parameters."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import avi_mjpeg, bpe, feistel, licenses, ngram_join, packing, sharding, topk_search, toxicity, warc
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), least=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), length=4096, end_id=2, keep_ids=False)


def op4_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_mjpeg.text_media(table(spark, sf_dir, "documents"))


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op7_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.by_bytes(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Setting of the session that holds the key of pseudonyms, and the key of a session without it, for trials alone.
KEY_SETTING, TRIAL_KEY = "spark.wavelode.pseudonym.key", "wavelode-trial-key"


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's key.  Without one a known key serves, whose pseudonyms anyone can undo: a warning says so."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms under the trial key can be undone by anyone", stacklevel=2)
    return (key or TRIAL_KEY).encode()


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = feistel.pseudonymize(docs, pseudonym_key(spark), spans_col="spans")
    return out.select("doc_id", "text", F.size("spans").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out()
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, model).withColumn("held_out", out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_threshold_topk": topk_search.search_sql(50, 5, 256), "op2_warc_index": warc.archive_sql(1000), "op6_license_digests": licenses.scan_sql(), "op9_ngram_jaccard_join": ngram_join.components_sql(4, 85, 100)}
