"""MPEG audio as a media column: writing payloads as variable-bitrate frames, and reading any such stream.

The reader resynchronises on frame headers, parses ID3 tags and variable-bitrate tables, verifies
checksums, and returns exact durations and the offset of every frame. The writer stores opaque
bytes in the ancillary part of layer III frames whose granules are silent.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field, replace
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silvae.llm import words as W
from silvae.llm.store import free, small_batches

#: Fixed values of the format: bit rates in kbit/s by (version 1 or 2, layer), sampling rates by version.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    mode: int
    extension: int
    #: Bytes of a frame of free format without padding; 0 for all others.
    loose: int = 0

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    @property
    def size(self) -> int:
        if self.loose:
            return self.loose + self.padding * (4 if self.layer == 1 else 1)
        if self.layer == 1:
            return (12000 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.bitrate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@functools.lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """A header from its four bytes; None for reserved values. The bit rate of free format is 0, and its size for the caller to find."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(word[1] >> 1 & 3)
    rate, speed = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer is None or rate == 15 or speed == 3 or word[3] & 3 == 2:
        return None
    mode = word[3] >> 6
    return Header(version, layer, not word[1] & 1, BITRATES[1 if version == 1 else 2, layer][rate], RATES[version][speed], word[2] >> 1 & 1, mode == 3, mode, word[3] >> 4 & 3)


def _table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _table()


@functools.lru_cache(maxsize=8192)
def crc16(data: bytes) -> int:
    """The frame checksum of the bytes it protects."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def crc_bits(bits: str) -> int:
    """The frame checksum of bits, which need not be whole bytes."""
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (b == "1") else 0)
    return c


def allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in layers I and II, the fixed values of the format's tables."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.bitrate // (1 if h.mono else 2)
    if each <= 48 and not h.loose:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each <= 80 else 7)


def protected(frame: bytes, h: Header) -> int | None:
    """The checksum that a frame of any layer should have; None if the frame is too short for what it protects."""
    if h.layer == 3:
        return crc16(bytes(frame[2:4] + frame[6 : 6 + h.side])) if len(frame) >= 6 + h.side else None
    sizes = allocation(h)
    both = len(sizes) if h.mode != 1 else min(len(sizes), 4 * (h.extension + 1))
    channels = 1 if h.mono else 2
    bits = format(int.from_bytes(frame[6:], "big"), f"0{8 * len(frame[6:])}b") if len(frame) > 6 else ""
    at = scale = 0
    for band, n in enumerate(sizes):
        # above the bound of joint stereo one allocation is of both channels
        for _ in range(channels if band < both else 1):
            scale += 2 * (1 if band < both else channels) * ("1" in bits[at : at + n])
            at += n
    at += scale if h.layer == 2 else 0
    return crc_bits(format(int.from_bytes(frame[2:4], "big"), "016b") + bits[:at]) if at <= len(bits) else None


@dataclass
class Stream:
    """What the reader found."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    duration: Fraction = Fraction(0)
    checked: int = 0
    bad: list[int] = field(default_factory=list)
    skipped: int = 0
    vbr: str | None = None
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: list[int] = field(default_factory=list)


def _safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _is_id3(data: bytes, at: int) -> bool:
    return data[at : at + 3] == b"ID3" and at + 10 <= len(data) and data[at + 3] < 16 and max(data[at + 6 : at + 10]) < 0x80


#: Names of the second version's text frames and what later ones call them.
_OLD_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TXX": "TXXX"}


def _text(body: bytes) -> str:
    return body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")


def _id3(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Parse an ID3v2 tag of version 2 to 4; the place after it. Compressed and encrypted frames are passed over."""
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + seven(data[at + 6 : at + 10]))
    body = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    p, width = 0, 6 if major == 2 else 10
    if flags & 0x40 and major > 2 and len(body) >= 4:
        p = seven(body) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    while p + width <= len(body) and body[p]:
        name = body[p : p + 4 - (major == 2)].decode("latin-1")
        n = int.from_bytes(body[p + 3 : p + 6], "big") if major == 2 else seven(body[p + 4 : p + 8]) if major == 4 else int.from_bytes(body[p + 4 : p + 8], "big")
        how = body[p + 9] if major > 2 else 0
        value = body[p + width : p + width + n]
        packed = how & (0x0C if major == 4 else 0xC0)
        if major == 4:
            value = value[4:] if how & 1 else value
            value = value.replace(b"\xff\x00", b"\xff") if how & 2 or flags & 0x80 else value
        if name[0] == "T" and value and not packed:
            name, text = _OLD_NAMES.get(name, name), _text(value)
            key, _, text = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = text.rstrip("\0")
        p += width + n
    return end + (10 if flags & 0x10 else 0)


def _vbr(frame: bytes, h: Header, out: Stream) -> bool:
    """Parse a Xing, Info or VBRI table in a frame; what the frame has no room for stays unset."""
    at = 4 + 2 * h.protected + h.side
    number = lambda p, n: int.from_bytes(frame[p : p + n], "big") if p + n <= len(frame) else None
    if frame[at : at + 4] in (b"Xing", b"Info") and (flags := number(at + 4, 4)) is not None:
        out.vbr, p = frame[at : at + 4].decode(), at + 8
        if flags & 1:
            out.vbr_frames, p = number(p, 4), p + 4
        if flags & 2:
            out.vbr_bytes, p = number(p, 4), p + 4
        if flags & 4:
            out.toc = list(frame[p : p + 100])
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", number(46, 4), number(50, 4)
        entries, scale, width, done = number(54, 2), number(56, 2), number(58, 2), 0
        for k in range(min(entries, (len(frame) - 62) // width) if width else 0):
            done += number(62 + k * width, width) * scale
            out.toc.append(done)
        return True
    return False


def _class(ok) -> bytes:
    return b"[" + b"".join(b"\\x%02x" % b for b in range(256) if ok(b)) + b"]"


#: Where a frame header may stand, or a tag begins.
_SYNC = re.compile(b"\xff" + _class(lambda b: b & 0xE0 == 0xE0 and b >> 3 & 3 != 1 and b >> 1 & 3) + _class(lambda b: b >> 4 != 15 and b >> 2 & 3 != 3) + _class(lambda b: b & 3 != 2) + b"|ID3|TAG")
#: Bytes of a frame of free format, at most.
_LOOSE = 8192


def _loose(data: bytes, at: int, h: Header) -> Header | None:
    """A header of free format with its size, which is the way to the next one like it."""
    head, p = bytes(data[at : at + 2]), at + 24
    while (p := data.find(head, p, at + _LOOSE)) > 0:
        if p + 4 <= len(data) and data[p + 2] & 0xFC == data[at + 2] & 0xFC and data[p + 3] & 0xC0 == data[at + 3] & 0xC0:
            size = p - at - h.padding * (4 if h.layer == 1 else 1)
            return replace(h, loose=size)
        p += 1
    return None


def read(data: bytes) -> tuple[Stream, list[tuple[int, int]]]:
    """The stream, and (start, stop) of each frame's bytes after header, checksum and side information.

    A header counts if the next one, where its frame ends, is of the same version, layer and rate, or
    the data end there. Bytes that belong to no frame or tag are skipped and counted. A frame that is
    cut short at the end is none. Any bytes can be read, in time that grows with their number."""
    out, spans, at, first = Stream(), [], 0, True
    synced, loose = False, 0
    while at < len(data):
        if _is_id3(data, at):
            at = min(len(data), _id3(data, at, out.tags))
            continue
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:
            for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                if text := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
                    out.tags.setdefault(name, text)
            break
        h = header(bytes(data[at : at + 4]))
        if h is not None and not h.bitrate:
            h = replace(h, loose=loose) if synced and loose else _loose(data, at, h)
        if h is not None and h.size > 4 and at + h.size <= len(data):
            end = at + h.size
            after = header(bytes(data[end : end + 4]))
            sure = end == len(data) or data[end : end + 3] in (b"ID3", b"TAG") or (after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate))
            if sure or synced:
                if h.protected and (want := protected(data[at:end], h)) is not None:
                    out.checked += 1
                    if int.from_bytes(data[at + 4 : at + 6], "big") != want:
                        out.bad.append(at)
                if not (first and h.layer == 3 and _vbr(data[at:end], h, out)):
                    out.offsets.append(at)
                    out.sizes.append(h.size)
                    out.samples += h.samples
                    out.rate = h.rate
                    out.duration += _seconds(h.samples, h.rate)
                    spans.append((min(end, at + 4 + 2 * h.protected + h.side), end))
                first, synced, loose, at = False, sure, h.loose, end
                continue
        synced = False
        found = _SYNC.search(data, at + 1)
        jump = found.start() if found else len(data)
        out.skipped += jump - at
        at = jump
    return out, spans


@functools.lru_cache(maxsize=64)
def _seconds(samples: int, rate: int) -> Fraction:
    return Fraction(samples, rate)


#: The writer's frames: MPEG-1 layer III, 48 kHz, one channel, with checksum.
_SIDE, _HEAD = 17, 4 + 2 + 17


@functools.lru_cache(maxsize=32)
def _start(rate_index: int) -> bytes:
    head = bytes([0xFF, 0xFA, rate_index << 4 | 1 << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(_SIDE))) + bytes(_SIDE)


def _room(rate_index: int) -> int:
    return 144 * BITRATES[1, 3][rate_index] // 48 - _HEAD


def write(payload: bytes) -> bytes:
    """A stream that holds ``payload``: ID3 tag with its length, Xing table, then frames of the highest rate and a last one of the lowest that has room."""
    top = _room(14)
    frames = [_start(14) + payload[k : k + top] for k in range(0, len(payload) - top + 1, top)]
    rest = payload[len(frames) * top :]
    if rest or not frames:
        rate = next(i for i in range(1, 15) if _room(i) >= len(rest))
        frames.append(_start(rate) + rest.ljust(_room(rate), b"\0"))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    table = 144 * BITRATES[1, 3][5] // 48
    total = table + sum(map(len, frames))
    toc, done, k = bytearray(), table, 0
    for percent in range(100):
        while k < percent * len(frames) // 100:
            done += len(frames[k])
            k += 1
        toc.append(min(255, done * 256 // total))
    xing = _start(5) + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    return b"ID3\x03\0\0" + _safe(len(tag)) + tag + xing.ljust(table, b"\0") + b"".join(frames)


def payload(data: bytes) -> tuple[bytes, Stream]:
    """The payload of ``write``, from the stored bytes, and the stream it was read from."""
    stream, spans = read(data)
    whole = b"".join([data[a:b] for a, b in spans])
    told = stream.tags.get("payload_bytes", "")
    return whole[: int(told)] if told.isascii() and told.isdigit() and len(told) < 19 else whole, stream


def feature(s: Stream) -> str:
    """What a search for media would compare: frames, exact seconds, table and the first and last frame's place."""
    ends = f"{s.offsets[0]}-{s.offsets[-1]}" if s.offsets else "-"
    return f"frames={len(s.offsets)};seconds={s.duration};rate={s.rate};vbr={s.vbr}:{s.vbr_frames}:{s.vbr_bytes};crc={s.checked - len(s.bad)}/{s.checked};skipped={s.skipped};offsets={ends}"


def store(docs: DataFrame, text_col: str = "text", out: str = "media", block: int = 64) -> DataFrame:
    """``docs`` with the binary column ``out``: each whole text in UTF-8, filled with bytes 0 to a positive multiple of ``block``.

    A null text is empty; equal texts have equal media. ``out`` must not be a column of ``docs``."""
    free(docs, out)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in W.slices(texts, 4 << 20):
                made = []
                for t in texts.slice(a, b - a):
                    data = (t.as_py() or "").encode()
                    made.append(write(data + bytes(-len(data) % block if data else block)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(made, pa.binary())], [*batch.schema.names, out])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


AUDIO = "payload binary, frames long, samples long, rate int, seconds string, vbr string, toc array<int>, offsets array<long>, crc_checked long, crc_bad long, skipped long, tags map<string,string>, feature string"


def analyse(rows: DataFrame, media_col: str = "media", out: str = "audio") -> DataFrame:
    """``rows`` with the struct column ``out`` read from any MPEG audio stream; exact seconds as a fraction.

    A null is an empty stream, and damaged bytes are those skipped; repeated rows get the same. ``out`` must not be a column of ``rows``."""
    free(rows, out)
    schema = T._parse_datatype_string(AUDIO)
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = pa.struct(list(to_arrow_schema(schema)))

    def run(batches):
        for batch in batches:
            media = batch.column(batch.schema.get_field_index(media_col))
            for a, b in W.slices(media, 4 << 20):
                got = []
                for m in media.slice(a, b - a):
                    data, s = payload(m.as_py() or b"")
                    got.append({"payload": data, "frames": len(s.offsets), "samples": s.samples, "rate": s.rate, "seconds": str(s.duration), "vbr": s.vbr, "toc": s.toc, "offsets": s.offsets, "crc_checked": s.checked, "crc_bad": len(s.bad), "skipped": s.skipped, "tags": list(s.tags.items()), "feature": feature(s)})
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got, kind)], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, schema)]))
