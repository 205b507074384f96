"""A corpus pipeline: toxic documents go, one of each group of near copies stays, private data gets pseudonyms, and what is left is packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavelode.llm import common, feistel, ngram_join, packing, queries, toxicity

#: Documents whose score reaches this are rejected.
TOXIC = 0.7
_SCORE = "toxicity_score_of_this_stage"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC`` by a model of the labelled rows that are not held out.

    A text in which nothing is found scores at most 1/2 and stays; so do null and empty texts, and all texts where
    the labels are of one kind only.
    """
    labels = common.table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs, model, score_col=_SCORE).where(F.col(_SCORE) < TOXIC).drop(_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id."""
    common.ship(spark)
    return ngram_join.drop_similar(docs, k=5, num=80, den=100)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with private data under format-preserving pseudonyms."""
    common.ship(spark)
    return feistel.pseudonymize(docs, queries.pseudonym_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    common.ship(spark)
    return packing.pack(docs, queries.vocabulary(), length=4096, end_id=2, keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("pii", pseudonymize), ("packing", pack)]

#: No stage but the join could be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return docs
