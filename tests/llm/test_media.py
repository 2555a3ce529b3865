"""WARC and MPEG audio: exact round trips, damaged input, and pushdown."""

import gzip
import hashlib
import os
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from silvae.llm import mpeg, op2_warc, op6_mpeg, warc
from tests.helpers import SF

# warc -------------------------------------------------------------------------------------------


def pages(spark):
    rows = [(1, "http://a/", "x" * 2000, None), (2, None, None, None), (3, "http://b/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" + "z" * 50, None), (4, "http://c/", "x" * 2000, 1)]
    return spark.createDataFrame(rows, "id long, u string, h string, r long")


def write(spark, path, compression):
    urn = lambda c: F.format_string("<urn:page:%d>", c)
    warc.write(warc.records(pages(spark), urn("id"), F.col("u"), F.col("h"), F.when(F.col("r").isNotNull(), urn("r"))), path, compression)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_and_pushdown(spark, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    write(spark, path, compression)
    got = {r.record_id: r for r in warc.load(spark, path).collect()}
    want = {f"<urn:page:{r.id}>": r for r in pages(spark).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k].record_type == ("revisit" if r.r else "response") and got[k].http_status == 200
        assert got[k].payload == (None if r.r else bytearray((r.h or "").encode()))
    assert got["<urn:page:3>"].target_uri == "http://b/ X: y"
    some = warc.load(spark, path, ["record_id", "record_type", "payload_bytes"]).where("record_type = 'revisit'")
    assert [r.payload_bytes for r in some.collect()] == [None]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan and some.count() == 1
    both = warc.load(spark, path).where("record_type in ('response', 'x') and target_uri = 'http://a/'")
    assert both.count() == 1


def test_reader_filters_before_payloads(spark, tmp_path):
    write(spark, f"file://{tmp_path}/w", "none")
    r = warc.WarcReader(warc.SCHEMA, {"path": f"file://{tmp_path}/w"})
    left = list(r.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("http_status",), 200)]))
    assert len(left) == 1 and r.wanted == [("warc-type", frozenset({"revisit"}))]
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert [x["record_id"] for x in rows] == ["<urn:page:4>"]
    assert len(warc.WarcReader(warc.SCHEMA, {"path": f"file://{tmp_path}/w", "partitionbytes": "1"}).partitions()) > 1


def record(kind, body, length=None):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <x>\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_other_writers_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("warcinfo", b"a: b")) + gzip.compress(record("resource", b"\x00\xff") + record("metadata", b"two")))
    (tmp_path / "b.warc").write_bytes(b"junk\n" + record("metadata", b"") + record("resource", b"cut short")[:-8])
    got = sorted((r.record_type, bytes(r.payload), r.complete, r.offset) for r in warc.load(spark, f"file://{tmp_path}").collect())
    first = len(gzip.compress(record("warcinfo", b"a: b")))
    assert got == [("metadata", b"", True, 5), ("metadata", b"two", True, None), ("resource", b"\x00\xff", True, first), ("resource", b"cut s", False, 5 + len(record("metadata", b""))), ("warcinfo", b"a: b", True, 0)]


@pytest.mark.parametrize("packed", [False, True])
def test_malformed_lengths(spark, tmp_path, packed):
    bad = [record("resource", b"no number", "abc"), record("resource", b"below none", "-5"), record("resource", b"far too long", "9" * 30), record("resource", b"none", "")]
    parts = [x for b in bad for x in (b, record("resource", b"good"))]
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data)
    assert [bytes(r.payload) for r in warc.load(spark, f"file://{tmp_path}").collect()] == [b"good"] * 4


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_places_of_records(spark, tmp_path, compression):
    """Small files, and records read again from their offsets; those that are not wanted are sought over."""
    path = f"file://{tmp_path}/w"
    rows = spark.range(300).select(F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("id") % 3 == 0, "resource").otherwise("other"), F.lit("\r\nWARC-Record-ID: "), F.col("id"), F.lit("\r\nContent-Length: "), F.length(F.repeat(F.md5(F.col("id").cast("string")), 30)), F.lit("\r\n\r\n"), F.repeat(F.md5(F.col("id").cast("string")), 30)).alias("value"))
    warc.write(rows.repartition(2), path, compression, file_bytes=20_000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3 and not (tmp_path / "w" / "_temporary").exists()
    some = warc.load(spark, path, ["record_id", "record_type", "file", "offset"]).where("record_type = 'resource'")
    assert sorted(int(r.record_id) for r in some.collect()) == list(range(0, 300, 3))
    got = warc.fetch(some, path, ["record_id", "payload"]).collect()
    assert {int(r.record_id): bytes(r.payload) for r in got} == {i: hashlib.md5(str(i).encode()).hexdigest().encode() * 30 for i in range(0, 300, 3)}
    assert warc.fetch(some.select("file", (F.col("offset") + 1).alias("offset")), path, ["record_id"]).count() == 0
    warc.write(rows.limit(5), path, compression)
    assert warc.load(spark, path, ["record_id"]).count() == 305


def test_members_tell_their_length(spark, tmp_path):
    write(spark, f"file://{tmp_path}/w", "gzip")
    for file in (tmp_path / "w").glob("*.gz"):
        data, n = file.read_bytes(), 0
        while data:
            size, inner = struct.unpack("<II", data[16:24])
            assert len(gzip.decompress(data[:size])) == inner
            data, n = data[size:], n + 1
    read = []
    real = zlib.decompressobj

    class Counted:
        def __init__(self, bits):
            self.d = real(bits)

        def decompress(self, *a):
            read.append(len(out := self.d.decompress(*a)))
            return out

        def __getattr__(self, n):
            return getattr(self.d, n)

    big = b"".join(warc.member(record(k, os.urandom(400_000))) for k in ("a", "b", "a"))
    (tmp_path / "x.warc.gz").write_bytes(big)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc.zlib, "decompressobj", Counted)
        with open(tmp_path / "x.warc.gz", "rb") as f:
            got = [h["warc-type"] for _, h, *_ in warc.parse(warc._Packed(f), lambda h: h["warc-type"] == "b", True)]
    assert got == ["b"] and sum(read) < 700_000


def test_empty_archive(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(pages(spark).limit(0), F.lit("x"), F.col("u"), F.col("h"), F.col("r").cast("string")), path)
    assert warc.load(spark, path).count() == 0


def test_query_with_nulls_and_copies(spark, tmp_path):
    rows = [(1, "u", "p" * 1000), (5, "u", "p" * 1000), (3, None, "p" * 1000), (4, "u", "q" * 999), (6, "u", "q" * 999), (7, "u", None), (5, "u", "p" * 1000), (None, "u", "r" * 1000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in op2_warc.op2_warc(spark, str(tmp_path)).collect()))
    assert got == [(0, "response", 0, 1000), (1, "revisit", 5, 1000), (3, "revisit", 5, 1000), (4, "response", 0, 999), (5, "response", 0, 1000), (5, "response", 0, 1000), (6, "response", 0, 999), (7, "response", 0, 0)]


def test_one_page_with_two_payloads(spark, tmp_path):
    """A row is a revisit of its own payload only; no payload is lost."""
    rows = [(7, "u", "A" * 1000), (9, "u", "A" * 1000), (7, "u", "B" * 1500), (None, "u", "A" * 1000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in op2_warc.op2_warc(spark, str(tmp_path)).collect())
    assert got == [(0, 1000, "response", 0), (7, 1000, "revisit", 9), (7, 1500, "response", 0), (9, 1000, "response", 0)]


# mpeg -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 64, 936, 937, 938, 1874, 50_000])
def test_payloads_come_back(n):
    data = random.Random(n).randbytes(n)
    media = mpeg.write(data)
    got, s = mpeg.payload(media)
    assert got == data and not s.bad and s.skipped == 0 and s.checked == len(s.offsets) + 1
    assert s.vbr == "Xing" and s.vbr_frames == len(s.offsets) and len(s.toc) == 100 and s.toc == sorted(s.toc)
    assert s.duration * 48000 == s.samples == 1152 * len(s.offsets)


def test_resynchronises_and_reports():
    media = mpeg.write(b"y" * 5000)
    s, _ = mpeg.read(b"junk" + media[:1500] + b"\xff\xfb\x00" + media[1500:] + b"TAG" + b"Song".ljust(125, b"\0"))
    assert s.tags["payload_bytes"] == "5000" and s.tags["TIT2"] == "Song" and s.skipped > 4 and len(s.offsets) >= 5
    broken = bytearray(media)
    at = s.offsets[0] - 4
    first = mpeg.read(media)[0].offsets[2]
    broken[first + 10] ^= 1
    assert mpeg.read(bytes(broken))[0].bad == [first] and at >= 0
    cut = mpeg.read(media[:-1])[0]
    assert len(cut.offsets) == len(mpeg.read(media)[0].offsets) - 1
    for data in (b"", b"\xff", b"\xff" * 100, b"ID3", b"ID3\x03\0\0\0\0\0\x7f", bytes(range(256)) * 20):
        assert mpeg.read(data)[0].offsets == []


def test_headers():
    h = mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.version, h.layer, h.bitrate, h.rate, h.size, h.samples, h.protected) == (1, 3, 128, 44100, 417, 1152, False)
    assert mpeg.header(bytes([0xFF, 0xF3, 0x48, 0xC4])).samples == 576 and mpeg.header(bytes([0xFF, 0xFF, 0x14, 0x00])).layer == 1
    assert mpeg.header(bytes([0xFF, 0xFB, 0xF0, 0x64])) is None and mpeg.header(bytes([0xFF, 0xFB, 0x00, 0x64])).bitrate == 0 and mpeg.header(b"\xff") is None


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc", 3), (2, None, None), (3, "", 1), (4, "abc", 2)], "doc_id long, text string, frames int")
    got = mpeg.analyse(mpeg.store(df)).orderBy("doc_id").collect()
    assert [bytes(r.audio.payload).rstrip(b"\0") for r in got] == [b"abc", b"", b"", b"abc"] and {len(r.audio.payload) for r in got} == {64}
    assert got[0].audio.feature == got[3].audio.feature and got[0].media == got[3].media and got[0].audio.seconds == "3/125"
    assert mpeg.analyse(spark.createDataFrame([(None,)], "media binary")).first().audio.frames == 0
    with pytest.raises(ValueError, match="media"):
        mpeg.store(df.withColumn("media", F.lit(1)))


def test_query_against_plain_python(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_mpeg.op6_mpeg_audio(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id]
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        media = mpeg.write(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256, r.crc_bad) == (len(media), hashlib.sha256(media).hexdigest(), 0)
        whole = len(data) // 937
        assert r.feature.startswith(f"frames={whole + (len(data) % 937 > 0)};") or len(data) % 937 == 0


def test_hostile_bytes():
    """Any bytes are read, and in linear time."""
    start = time.perf_counter()
    assert mpeg.read(b"\xff" * 10_000_000)[0].skipped == 10_000_000
    assert mpeg.read(b"ID3" * 300_000)[0].offsets == [] and mpeg.read(b"TAG" * 300_000)[0].offsets == []
    assert time.perf_counter() - start < 5
    start = time.perf_counter()
    mpeg.read(b"\xff\xfb\x00\x00" * 50_000)
    mpeg.read(b"\xff\xfb\x90\x64" * 50_000)
    assert time.perf_counter() - start < 10
    short = bytearray(b"\xff\xf3\x14\xc4" + bytes(68))
    short[36:40] = b"VBRI"
    assert mpeg.read(bytes(short))[0].vbr in ("VBRI", None)
    vbri = bytearray(b"\xff\xfb\x90\xc4" + bytes(413))
    vbri[36:40], vbri[54:60] = b"VBRI", b"\xff\xff\x00\x01\x00\x02"
    assert len(mpeg.read(bytes(vbri) * 2)[0].toc) == (417 - 62) // 2


def test_damaged_streams():
    r = random.Random(12)
    media = mpeg.write(r.randbytes(3000))
    for _ in range(10_000):
        data = bytearray(media[: r.choice([len(media), r.randrange(len(media))])])
        for _ in range(r.randint(1, 12)):
            if data:
                at = r.randrange(min(len(data), r.choice([60, 600, len(data)])))
                data[at : at + r.choice([0, 1, 1, 3])] = r.randbytes(r.choice([0, 1, 1, 2]))
        got, s = mpeg.payload(bytes(data))
        assert s.samples >= 0 and s.skipped <= len(data)
    odd = media.replace(b"payload_bytes\x003008", b"payload_bytes\x003x08")
    assert len(mpeg.payload(odd)[0]) >= 3000


def test_tags_of_all_versions():
    def tag(major, flags, body):
        return b"ID3" + bytes([major, 0, flags]) + mpeg._safe(len(body)) + body

    text = b"\x00Song"
    old = tag(2, 0, b"TT2" + len(text).to_bytes(3, "big") + text + b"TXX" + (6).to_bytes(3, "big") + b"\x00k\x00val"[:6])
    assert mpeg.read(old)[0].tags == {"TIT2": "Song", "k": "val"}
    frame = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    assert mpeg.read(tag(3, 0, frame))[0].tags == mpeg.read(tag(4, 0, frame))[0].tags == {"TIT2": "Song"}
    assert mpeg.read(tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + frame))[0].tags == {"TIT2": "Song"}
    assert mpeg.read(tag(4, 0x40, mpeg._safe(6) + b"\x01\x00" + frame))[0].tags == {"TIT2": "Song"}
    wide = "ÿ".encode("latin-1")
    loud = b"TIT2" + (3).to_bytes(4, "big") + b"\0\0" + b"\x00" + wide + b"a"
    assert mpeg.read(tag(3, 0x80, loud.replace(wide, wide + b"\0")))[0].tags == {"TIT2": "ÿa"}


@pytest.mark.parametrize("word", [b"\xff\xfe\x40\x00", b"\xff\xfe\x40\x50", b"\xff\xfe\x40\xc0", b"\xff\xfc\x80\x00", b"\xff\xfc\x80\x40", b"\xff\xfc\x24\xc0", b"\xff\xf4\x80\x00", b"\xff\xfa\x90\x00"])
def test_checksums_of_all_layers(word):
    """A frame with its checksum is good, and bad after a bit that it protects is turned; one beyond changes nothing."""
    r = random.Random(1)
    h = mpeg.header(word)
    frame = bytearray(word + r.randbytes(h.size - 4))
    frame[4:6] = mpeg.protected(bytes(frame), h).to_bytes(2, "big")
    two = bytes(frame) * 2
    assert mpeg.read(two)[0].checked == 2 and mpeg.read(two)[0].bad == []
    frame[7] ^= 16
    assert mpeg.read(bytes(frame) + two)[0].bad == [0]
    frame[7] ^= 16
    frame[-1] ^= 1
    assert mpeg.read(bytes(frame) + two)[0].bad == []


def test_free_format():
    frame = b"\xff\xfb\x00\x64" + bytes(500)
    s = mpeg.read(frame * 5)[0]
    assert s.sizes == [504] * len(s.sizes) and len(s.sizes) >= 4
