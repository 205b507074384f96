"""Balanced contiguous shards: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are taken in the order of their id.  Each partition of the range-sorted, narrow rows sums its
own bytes, one total per partition gives every row the bytes before it in the whole table, and the
row goes to the shard in whose equal share of the bytes its middle lies.  No shard is off by more
than one row's size.  Texts themselves are not moved.

Null text counts as empty.  Null ids come first; repeated rows are rows of their own, told apart by
size and checksum where ids tie.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``: slot is the row's place in its shard."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed, _, total = common.global_prefix(rows, [id_col, "size", "text_crc32"], "size", "shards")
    middle = F.col("weight_at") * 2 + F.col("size")
    share = F.expr(f"cast(({{}}) div {2 * max(total, 1)} as int)".format(f"(weight_at * 2 + size) * {int(shards)}")) if total * 2 * shards < 2**63 else F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)).cast("int")
    cut = placed.withColumn("shard", F.least(share, F.lit(shards - 1)))
    first = cut.groupBy("shard").agg(F.min("row_at").alias("first"))  # a row per shard
    out = cut.join(F.broadcast(first), "shard")
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("row_at") - F.col("first")).alias("slot"))
