"""Ogg streams (RFC 3533, RFC 7845) as tables of pages and packets.

``parse_pages`` is the pure parser: one generator over a file's bytes.  ``read_pages`` applies it to files
that Spark lists and reads (``binaryFile``), so any store that Spark reads will do; the ``ogg`` data source
offers the same as ``spark.read.format("ogg")``.  ``packets`` reassembles packets from pages with window
functions: a segment of less than 255 bytes ends a packet, across pages; a page that continues a packet
nobody began is skipped up to the next boundary, and a missing page or a cut end is an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.crc import ogg_crc
from ..functions.toc import byte_at

PAGE_SCHEMA = "path string, page_pos long, granule long, header_type int, serial long, page_index long, lacing array<int>, segments array<binary>, crc_ok boolean, error string"
_ARROW = pa.schema([("path", pa.string()), ("page_pos", pa.int64()), ("granule", pa.int64()), ("header_type", pa.int32()), ("serial", pa.int64()), ("page_index", pa.int64()), ("lacing", pa.list_(pa.int32())), ("segments", pa.list_(pa.binary())), ("crc_ok", pa.bool_()), ("error", pa.string())])
CONTINUED, FIRST, LAST = 1, 2, 4
#: Bytes of pages that a batch holds at least before it is passed on.
BATCH_BYTES = 4 << 20


def parse_pages(data: bytes) -> Iterator[tuple]:
    """``(page_pos, granule, header_type, serial, page_index, lacing, segments, crc_ok, error)`` of each page; an error ends the file."""
    at, k = 0, 0
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            yield (k, None, None, None, None, None, None, None, "bad signature")
            return
        if at + 27 > len(data):
            yield (k, None, None, None, None, None, None, None, "short page header")
            return
        _, kind, granule, serial, index, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = list(data[at + 27 : at + 27 + n])
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            yield (k, granule, kind, serial, index, lacing, None, None, "short page")
            return
        segments, place = [], body
        for size in lacing:
            segments.append(data[place : place + size])
            place += size
        page = bytearray(data[at:end])
        page[22:26] = b"\0\0\0\0"
        yield (k, granule, kind, serial, index, lacing, segments, ogg_crc(bytes(page)) == crc, None)
        at, k = end, k + 1


def build_page(serial: int, index: int, segments: list[bytes], granule: int = 0, header_type: int = 0) -> bytes:
    """A page of at most 255 segments with its checksum."""
    page = bytearray(b"OggS" + struct.pack("<BBqIIIB", 0, header_type, granule, serial, index, 0, len(segments)) + bytes(map(len, segments)) + b"".join(segments))
    page[22:26] = struct.pack("<I", ogg_crc(bytes(page)))
    return bytes(page)


def build_stream(serial: int, packets: list[bytes], head: bytes | None = None) -> bytes:
    """A logical stream: an identification page if ``head`` is given, then the packets, over pages of 255 segments."""
    pages, index = [], 0
    if head is not None:
        pages.append(build_page(serial, index, [head], header_type=FIRST))
        index += 1
    pieces: list[bytes] = []
    for p in packets:
        pieces += [p[i : i + 255] for i in range(0, len(p), 255)]
        if len(p) % 255 == 0:
            pieces.append(b"")
    for i in range(0, len(pieces), 255):
        continued = i > 0 and len(pieces[i - 1]) == 255
        last = LAST if i + 255 >= len(pieces) else 0
        pages.append(build_page(serial, index, pieces[i : i + 255], granule=i, header_type=(CONTINUED if continued else 0) | last))
        index += 1
    return b"".join(pages)


def build_head(channels: int = 2, pre_skip: int = 0, rate: int = 48000, gain: int = 0, family: int = 0, mapping: bytes = b"") -> bytes:
    return b"OpusHead" + struct.pack("<BBHIhB", 1, channels, pre_skip, rate, gain, family) + mapping


def parse_head(packet: bytes) -> dict:
    """The identification header; ``mapping`` by family: none for 0, streams for 1, 2 and 255, a matrix for 3."""
    if packet[:8] != b"OpusHead" or len(packet) < 19:
        raise ValueError("no identification header")
    version, channels, pre_skip, rate, gain, family = struct.unpack_from("<BBHIhB", packet, 8)
    out = {"version": version, "channels": channels, "pre_skip": pre_skip, "sample_rate": rate, "output_gain": gain, "channel_map": family, "stream_count": None, "coupled_count": None, "mapping": None, "demix": None}
    if family == 0:
        if len(packet) != 19:
            raise ValueError("family 0 has no channel map")
    elif family in (1, 2, 255):
        if len(packet) != 21 + channels:
            raise ValueError("the channel map's length is wrong")
        out |= {"stream_count": packet[19], "coupled_count": packet[20], "mapping": list(packet[21:])}
    elif family == 3:
        inputs = packet[19] + packet[20] if len(packet) > 20 else 0
        if len(packet) != 21 + 2 * channels * inputs:
            raise ValueError("the demixing matrix's length is wrong")
        out |= {"stream_count": packet[19], "coupled_count": packet[20], "demix": list(struct.unpack_from(f"<{channels * inputs}h", packet, 21))}
    return out


def _page_batches(rows: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    for path, data in rows:
        for page in parse_pages(data):
            held.append((path, *page))
            size += sum(page[5] or ()) + 64
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
    yield batch()


def pages_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Pages of files in a column; one file is parsed in one task, page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _page_batches((p.as_py(), c.as_py() or b"") for b in batches for p, c in zip(b.column(0), b.column(1), strict=True))

    return files.select(F.col(path).cast("string"), content).mapInArrow(run, PAGE_SCHEMA)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages_of(spark.read.format("binaryFile").load(path))


class OggDataSource(DataSource):
    """``spark.read.format("ogg").load(path)``: pages of a file, or of the files of a folder, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "ogg"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _OggReader(self.options["path"])


class _OggReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._open()
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with self._open()[0].open_input_stream(partition.value) as f:
            yield from _page_batches(iter([(partition.value, f.read())]))


def packets(pages: DataFrame) -> DataFrame:
    """``path, serial, packet_pos, page_index, granule, payload, error``: packets with their completing page, and errors.

    Streams are keyed by path and serial number.  Order comes from ``page_pos`` alone.  The window is per
    stream, as the format is; pages of many streams are spread by the shuffle.
    """
    stream = Window.partitionBy("path", "serial").orderBy("page_pos")
    good = pages.where("error IS NULL AND serial IS NOT NULL AND size(lacing) > 0")
    p = good.withColumn("open_end", F.element_at("lacing", -1) == 255).withColumn("continued", F.col("header_type").bitwiseAND(CONTINUED) != 0)
    p = p.withColumns({"had_open": F.coalesce(F.lag("open_end").over(stream), F.lit(False)), "last_index": F.lag("page_index").over(stream)})
    gap = F.col("had_open") & (~F.col("continued") | (F.col("page_index") != F.col("last_index") + 1))
    late = F.col("continued") & ~F.col("had_open")
    p = p.withColumn("gap", gap).withColumn("late", late)
    cell = p.select("path", "serial", "page_pos", "page_index", "granule", "gap", "late", F.posexplode(F.arrays_zip("lacing", "segments")).alias("k", "z"))
    cell = cell.select("*", F.col("z.lacing").alias("size"), F.col("z.segments").alias("data"))
    order = Window.partitionBy("path", "serial").orderBy("page_pos", "k")
    ends = (F.col("size") < 255).cast("long")
    # a packet's number counts the ends before it, and the gaps: what a gap cuts off is a packet of its own, without an end
    cell = cell.withColumn("ends_before", F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cell = cell.withColumn("gaps", F.sum((F.col("gap") & (F.col("k") == 0)).cast("long")).over(order))
    whole = cell.groupBy("path", "serial", "ends_before", "gaps").agg(
        F.array_sort(F.collect_list(F.struct("page_pos", "k", "data"))).alias("parts"),
        F.max(F.struct("page_pos", "page_index", "granule")).alias("page"),
        F.max((F.col("size") < 255)).alias("ended"),
        F.min_by("late", F.struct("page_pos", "k")).alias("late"),
        F.min_by(F.col("gap") & (F.col("k") == 0), F.struct("page_pos", "k")).alias("cut"),
        F.min("page_pos").alias("first_page"),
    )
    # the packet that a late or cut page goes on with has no beginning: it is not passed on
    first_of_page = cell.where("k = 0 AND late").select("path", "serial", "ends_before", "gaps").distinct().withColumn("headless", F.lit(True))
    whole = whole.join(first_of_page, ["path", "serial", "ends_before", "gaps"], "left").where("headless IS NULL")
    error = F.when(~F.col("ended"), "unexpected end")
    out = whole.select("path", "serial", "ends_before", "gaps", F.col("page.page_index").alias("page_index"), F.col("page.granule").alias("granule"), F.when(F.col("ended"), F.reduce("parts", F.lit(b""), lambda a, x: F.concat(a, x["data"]))).alias("payload"), error.alias("error"))
    number = Window.partitionBy("path", "serial").orderBy("ends_before", "gaps")
    return out.withColumn("packet_pos", F.row_number().over(number) - 1).select("path", "serial", "packet_pos", "page_index", "granule", "payload", "error")


def heads(table: DataFrame, payload: str = "payload") -> DataFrame:
    """Identification headers as columns, from packets (or segments) that begin with the signature.

    ``error`` is null for a header whose channel map has the length that its family asks for.
    """
    p = F.col(payload)
    byte = lambda i: byte_at(p, i)
    rows = table.where(F.substring(payload, 1, 8) == F.lit(b"OpusHead"))
    n, family, inputs = F.octet_length(payload), byte(18), byte(19) + byte(20)
    gain = byte(16) + 256 * byte(17)
    out = rows.withColumns({
        "version": byte(8),
        "channels": byte(9),
        "pre_skip": byte(10) + 256 * byte(11),
        "sample_rate": (byte(12) + 256 * byte(13) + 65536 * byte(14)).cast("long") + F.lit(2**24) * byte(15),
        "output_gain": F.when(gain >= 32768, gain - 65536).otherwise(gain),
        "channel_map": family,
        "stream_count": F.when(family != 0, byte(19)),
        "coupled_count": F.when(family != 0, byte(20)),
    })
    mapped = family.isin(1, 2, 255)
    wanted = F.when(family == 0, 19).when(mapped, 21 + F.col("channels")).when(family == 3, 21 + 2 * F.col("channels") * inputs).otherwise(n)
    out = out.withColumn("error", F.when(n < 19, "short header").when(~F.coalesce(n == wanted, F.lit(False)), "the channel map's length is wrong"))
    places = F.sequence(F.lit(0), F.col("channels") - 1)
    good = F.col("error").isNull()
    out = out.withColumn("mapping", F.when(good & mapped, F.transform(places, lambda i: byte_at(p, i + 21))))
    cell = lambda i: byte_at(p, 2 * i + 21) + 256 * byte_at(p, 2 * i + 22)
    cells = F.sequence(F.lit(0), F.greatest(F.col("channels") * inputs - 1, F.lit(0)))
    return out.withColumn("demix", F.when(good & (family == 3), F.transform(cells, lambda i: F.when(cell(i) >= 32768, cell(i) - 65536).otherwise(cell(i)))))
