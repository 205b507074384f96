"""Packet framing (RFC 6716, section 3.2): a packet's frames, or the rule it breaks.

Rules, in the order they decide: R1 no byte; R2 a frame over 1275 bytes; R3 code 1 with an odd payload;
R4 code 2 whose first length cannot be read or does not fit; R5 code 3 without frames or over 120 ms;
R6 padding that does not fit, or a payload that does not divide; R7 variable lengths that do not fit.

Everything is a Column: the few header bytes are read from the packet's hexadecimal form, padding and
variable lengths are folds over them, and a frame is a pair of offset and length until its bytes are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import toc

LARGEST_FRAME = 1275
LONGEST_NS = 120_000_000
HEADER_REACH = 2 + 1 + 2 * 48


def _byte(digits: Column, place: Column) -> Column:
    """Byte ``place`` (from 0) of a hexadecimal string; null beyond its end."""
    two = F.substring(digits, place * 2 + 1, F.lit(2))
    return F.when(F.length(two) == 2, F.conv(two, 16, 10).cast("int"))


def padding(digits: Column, start: Column, size: Column) -> Column:
    """Fold over padding bytes: ``struct(used, bytes, done)``; a byte of 255 counts 254 and goes on."""
    none = F.struct(F.lit(0).alias("used"), F.lit(0).alias("bytes"), F.lit(False).alias("done"))

    def step(acc: Column, place: Column) -> Column:
        b = _byte(digits, place)
        more = F.struct((acc["used"] + 1).alias("used"), (acc["bytes"] + F.when(b == 255, 254).otherwise(b)).alias("bytes"), (b != 255).alias("done"))
        return F.when(acc["done"], acc).otherwise(more)

    # the run of 255 bytes is found first, so the fold is no longer than it
    run = (F.length(F.regexp_extract(F.substring(digits, start * 2 + 1, F.lit(2**30)), "^((?:FF)*)", 1)) / 2).cast("int")
    places = F.when(size > start, F.sequence(start, F.least(size - 1, start + run))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, none, step)


def variable_lengths(digits: Column, start: Column, end: Column, count: Column) -> Column:
    """Fold over coded lengths: ``struct(place, lengths, ok)`` for ``count`` frames, one or two bytes each."""
    none = F.struct(start.cast("int").alias("place"), F.array().cast("array<int>").alias("lengths"), F.lit(True).alias("ok"))

    def step(acc: Column, _: Column) -> Column:
        one, two = _byte(digits, acc["place"]), _byte(digits, acc["place"] + 1)
        wide = one >= 252
        fits = acc["ok"] & F.coalesce(acc["place"] + F.when(wide, 2).otherwise(1) <= end, F.lit(False)) & one.isNotNull()
        length = F.when(wide, one + 4 * two).otherwise(one)
        good = F.struct((acc["place"] + F.when(wide, 2).otherwise(1)).cast("int").alias("place"), F.array_append(acc["lengths"], length).alias("lengths"), F.lit(True).alias("ok"))
        bad = F.struct(acc["place"].alias("place"), acc["lengths"].alias("lengths"), F.lit(False).alias("ok"))
        return F.when(fits, good).otherwise(bad)

    return F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), none, step)


def parse(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the TOC columns, ``lengths array<int>``, ``first`` (offset of the first frame), ``padding_bytes`` and ``error`` (a rule or null)."""
    out = toc.with_config(packets, payload)
    size = F.octet_length(payload)
    # the header's reach: two bytes, a byte of padding, and two bytes for each of at most 48 lengths; a chain of padding bytes may be longer
    reach = F.when(F.substring(payload, 3, 1) == F.lit(b"\xff"), F.col(payload)).otherwise(F.substring(payload, 1, HEADER_REACH))
    out = out.withColumn("_n", F.coalesce(size, F.lit(0))).withColumn("_hex", F.hex(reach))
    code, n, digits = F.col("frame_code"), F.col("_n"), F.col("_hex")
    count_byte = _byte(digits, F.lit(1))
    out = out.withColumn("_count", F.when(code == 3, count_byte))
    m = F.when(code == 3, F.col("_count").bitwiseAND(63)).when(code == 0, 1).when(code.isin(1, 2), 2)
    out = out.withColumns({"n_frames": m.cast("int"), "is_vbr": F.when(code == 3, F.col("_count") >= 128), "has_padding": F.when(code == 3, F.col("_count").bitwiseAND(64) != 0)})
    out = out.withColumn("_pad", F.when(F.col("has_padding"), padding(digits, F.lit(2), n)))
    pad_used, pad_bytes = F.coalesce(F.col("_pad.used"), F.lit(0)), F.coalesce(F.col("_pad.bytes"), F.lit(0))
    out = out.withColumns({"_head": (2 + pad_used).cast("int"), "padding_bytes": pad_bytes, "_end": (n - pad_bytes).cast("int")})
    pad_ok = ~F.coalesce("has_padding", F.lit(False)) | (F.coalesce(F.col("_pad.done"), F.lit(False)) & (F.col("_head") <= F.col("_end")))
    counted = (F.col("n_frames") >= 1) & (F.col("n_frames") * F.col("frame_ns") <= LONGEST_NS)
    out = out.withColumn("_ok3", F.coalesce(counted & pad_ok, F.lit(False)))
    coded = F.when(code == 2, variable_lengths(digits, F.lit(1), n, F.lit(1))).when((code == 3) & F.col("is_vbr") & F.col("_ok3"), variable_lengths(digits, F.col("_head"), F.col("_end"), F.col("n_frames") - 1))
    out = out.withColumn("_coded", coded)
    sum_of = F.aggregate(F.col("_coded.lengths"), F.lit(0), lambda a, x: a + x)
    rest = F.when(code == 2, n).otherwise(F.col("_end")) - F.col("_coded.place") - sum_of
    body = F.col("_end") - F.col("_head")
    parts = F.greatest("n_frames", F.lit(1))
    each = F.floor(body / parts).cast("int")
    lengths = (
        F.when(code == 0, F.array((n - 1).cast("int")))
        .when(code == 1, F.array_repeat(F.floor((n - 1) / 2).cast("int"), 2))
        .when(F.col("_coded").isNotNull(), F.array_append(F.col("_coded.lengths"), rest.cast("int")))
        .when(code == 3, F.array_repeat(each, parts))
    )
    out = out.withColumn("_lengths", lengths)
    largest = F.coalesce(F.array_max("_lengths"), F.lit(0))
    implicit = F.element_at("_lengths", -1)
    error = (
        F.when(n < 1, "R1")
        .when((code == 1) & ((n - 1) % 2 != 0), "R3")
        .when((code == 2) & (~F.col("_coded.ok") | (rest < 0)), "R4")
        .when((code == 3) & ~F.coalesce(counted, F.lit(False)), "R5")
        .when((code == 3) & ~pad_ok, "R6")
        .when((code == 3) & ~F.col("is_vbr") & (body % parts != 0), "R6")
        .when((code == 3) & F.col("is_vbr") & (~F.col("_coded.ok") | (rest < 0)), "R7")
        .when((implicit > LARGEST_FRAME) | (largest > LARGEST_FRAME), "R2")
    )
    out = out.withColumn("error", error)
    good = F.col("error").isNull()
    first = F.when(code < 2, 1).when(F.col("_coded").isNotNull(), F.col("_coded.place")).otherwise(F.col("_head"))
    out = out.withColumns({"lengths": F.when(good, F.col("_lengths")), "first": F.when(good, first.cast("int"))})
    return out.drop("_n", "_hex", "_count", "_pad", "_head", "_end", "_ok3", "_coded", "_lengths")


def frames(parsed: DataFrame, payload: str = "payload", with_data: bool = True) -> DataFrame:
    """A row per frame of the packets without error: ``frame_pos, frame_offset, frame_length`` and ``data``."""
    keep = [c for c in parsed.columns if c != payload or with_data]
    # packets with an error have no lengths; one fold gives every frame its place
    start = F.struct(F.col("first").cast("int").alias("at"), F.array().cast("array<struct<frame_offset:int,frame_length:int>>").alias("all"))
    placed = F.aggregate("lengths", start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], F.struct(a["at"].alias("frame_offset"), x.alias("frame_length"))).alias("all")), lambda a: a["all"])
    out = parsed.select(*keep, F.posexplode(placed).alias("frame_pos", "_frame")).select(*keep, "frame_pos", "_frame.frame_length", "_frame.frame_offset")
    if with_data:
        out = out.withColumn("data", F.substring(payload, F.col("frame_offset") + 1, F.col("frame_length"))).drop(payload)
    return out


def duration_ns(parsed: DataFrame) -> DataFrame:
    """Adds ``packet_ns``, what all frames of the packet last."""
    return parsed.withColumn("packet_ns", F.col("n_frames") * F.col("frame_ns"))
