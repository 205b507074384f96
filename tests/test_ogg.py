import random

import pytest

from wavelode.sources import ogg

PACKETS = [bytes(random.Random(n).randrange(256) for _ in range(n)) for n in (0, 1, 254, 255, 256, 70000, 70001, 510, 3)]

# The two pages of a short stream.
TWO_PAGES = bytes.fromhex("4f676753000200000000000000008e9b20aa0000000061ee611701134f707573486561640102000f80bb00000000004f6767530000da93c2d9000000008e9b20aa02000000499703370105983 6be889e".replace(" ", ""))


def split(data):
    out, at = [], 0
    for p in ogg.parse_pages(data):
        n = 27 + len(p[5]) + sum(p[5])
        out.append(data[at : at + n])
        at += n
    return out


def test_two_pages():
    first, second = ogg.parse_pages(TWO_PAGES)
    assert first[7] and second[7] and second[6] == [bytes.fromhex("9836be889e")]
    head = ogg.parse_head(first[6][0])
    assert (head["version"], head["channels"], head["pre_skip"], head["sample_rate"], head["output_gain"], head["channel_map"]) == (1, 2, 0x0F00, 48000, 0, 0)
    damaged = bytearray(TWO_PAGES)
    damaged[40] ^= 1
    assert next(ogg.parse_pages(bytes(damaged)))[7] is False


def test_heads():
    assert ogg.parse_head(ogg.build_head(6, family=1, mapping=bytes([4, 2, 0, 4, 1, 2, 3, 5])))["mapping"] == [0, 4, 1, 2, 3, 5]
    assert ogg.parse_head(ogg.build_head(1, family=3, mapping=bytes([1, 0, 0xFF, 0x7F])))["demix"] == [32767]
    for bad in (b"", b"OpusTags" + bytes(20), ogg.build_head() + b"x", ogg.build_head(2, family=1, mapping=b"\1")):
        with pytest.raises(ValueError):
            ogg.parse_head(bad)


def test_packets(spark):
    whole = ogg.build_stream(7, PACKETS, ogg.build_head())
    pages = split(whole)
    assert len(pages) >= 4
    files = {"whole": whole, "gap": b"".join(pages[:2] + pages[3:]), "late": b"".join(pages[2:]), "cut": b"".join(pages[:-1]), "bad": b"xx" + whole, "empty": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    table = ogg.pages_of(rows)
    assert [r.error for r in table.where("path = 'bad'").collect()] == ["bad signature"]
    out = {}
    for r in ogg.packets(table).orderBy("path", "packet_pos").collect():
        out.setdefault(r.path, []).append(bytes(r.payload) if r.error is None else r.error)
    assert out["whole"][1:] == PACKETS
    assert out["late"] == PACKETS[-len(out["late"]) :]
    assert out["cut"][-1] == "unexpected end"
    assert "unexpected end" in out["gap"] and out["gap"][-2:] == PACKETS[-2:]


def test_data_source(spark, tmp_path):
    (tmp_path / "a.ogg").write_bytes(ogg.build_stream(1, PACKETS))
    spark.dataSource.register(ogg.OggDataSource)
    a = spark.read.format("ogg").load(str(tmp_path))
    b = ogg.read_pages(spark, str(tmp_path))
    assert a.drop("path").collect() == b.drop("path").collect()


def test_head_columns(spark):
    made = [ogg.build_head(2, 312, 44100, -256), ogg.build_head(6, family=1, mapping=bytes([4, 2, 0, 4, 1, 2, 3, 5])), ogg.build_head(1, family=3, mapping=bytes([1, 0, 0xFF, 0xFF])), ogg.build_head() + b"x", ogg.build_head(2, family=1, mapping=b"\1"), b"OpusTags", b"OpusHead\1"]
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(made)], "i int, payload binary")
    out = {r.i: r for r in ogg.heads(rows).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 6]
    for i in range(3):
        want = ogg.parse_head(made[i])
        assert all(out[i][k] == v for k, v in want.items()) and out[i].error is None
    assert out[3].error and out[4].error and out[6].error
