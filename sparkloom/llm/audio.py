"""MPEG audio columns: frame headers resynchronised, tags and variable-bitrate tables parsed, checksums verified.

``parse`` walks a stream's bytes once. It steps over tags, seeks the next header whose successor stands where it says and
agrees with it, follows the frames, and seeks again when a frame is broken. Durations are exact: samples and the sample
rate, of which microseconds are derived. Frame offsets are kept, one a frame, so that a reader can seek to any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import per_batch

#: Kilobits a second by (version 1?, layer), sample rates by version bits (ISO 11172-3, 13818-3 and the 2.5 extension).
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # its two bits: 3 is MPEG 1, 2 MPEG 2, 0 MPEG 2.5
    layer: int
    protected: bool
    kbps: int  # 0: free format
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def length(self) -> int:
        """Bytes of the frame; 0 in free format."""
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4 if self.kbps else 0
        return 125 * self.samples * self.kbps // self.rate + self.padding if self.kbps else 0

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mode == 3 else 32) if self.version == 3 else (9 if self.mode == 3 else 17)

    def agrees(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate, self.kbps == 0) == (other.version, other.layer, other.rate, other.kbps == 0)


_HEADERS: dict[bytes, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    """The header at ``at``, if the four bytes there are one."""
    key = data[at : at + 4]
    try:
        return _HEADERS[key]
    except KeyError:
        pass
    h = None
    if len(key) == 4 and key[0] == 0xFF and key[1] >= 0xE0:
        version, layer, kbps, rate = key[1] >> 3 & 3, 4 - (key[1] >> 1 & 3), key[2] >> 4, key[2] >> 2 & 3
        if version != 1 and layer != 4 and kbps != 15 and rate != 3 and key[3] & 3 != 2:
            h = Header(version, layer, not key[1] & 1, RATES[version == 3, layer][kbps], SAMPLE_RATES[version][rate], key[2] >> 1 & 1, key[3] >> 6, key[3] >> 4 & 3)
    if len(_HEADERS) < 100_000:
        _HEADERS[key] = h
    return h


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None, crc: int = 0xFFFF) -> int:
    """The standard's checksum of the first ``bits`` bits (all by default)."""
    bits = len(data) * 8 if bits is None else bits
    for b in data[: bits // 8]:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ b]
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        crc = (crc << 1 ^ 0x8005 if crc >> 15 ^ bit else crc << 1) & 0xFFFF
    return crc


def _layer2_bits(h: Header) -> list[int]:
    """Bits of the allocation of every subband (ISO 11172-3, tables B.2)."""
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // h.channels
    if h.kbps and (h.rate == 48000 and each >= 56 or 56 <= each <= 80):
        return [4] * 11 + [3] * 12 + [2] * 4
    if not h.kbps or each >= 96:
        return [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 else 7)
    return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers, besides the header's last 16."""
    bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (min(bound, 32) * h.channels + (32 - min(bound, 32)))
    value, left, size, scf = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512, 0, 0
    for band, n in enumerate(_layer2_bits(h)):
        for _ in range(h.channels if band < bound else 1):
            left, size = left - n, size + n
            if value >> left & ((1 << n) - 1):
                scf += 2 if band < bound else 2 * h.channels
    return size + scf


def checksum(data: bytes, at: int, h: Header) -> bool:
    """Whether the frame's checksum is right."""
    body = data[at + 6 : at + 70]
    bits = protected_bits(h, body)
    return len(body) * 8 >= bits and crc16(body, bits, crc16(data[at + 2 : at + 4])) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    version: int | None = None
    layer: int | None = None
    channels: int | None = None
    sample_rate: int | None = None
    n_frames: int = 0
    n_samples: int = 0
    delay: int = 0
    padding: int = 0
    n_resyncs: int = 0
    junk_bytes: int = 0
    n_checked: int = 0
    n_bad_checksums: int = 0
    title: str | None = None
    artist: str | None = None
    album: str | None = None
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] | None = None
    offsets: list[int] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        """Microseconds of sound, rounded half up, less the encoder's delay and padding."""
        if not self.sample_rate:
            return 0
        return int(Fraction(max(0, self.n_samples - self.delay - self.padding) * 1_000_000, self.sample_rate) + Fraction(1, 2))


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """The end of the tag that begins at ``at``; its text frames go to ``out``, the first of a kind counts."""
    size, major, flags = _synchsafe(data[at + 6 : at + 10]), data[at + 3], data[at + 5]
    end = at + 10 + size + (10 if flags & 0x10 else 0)
    body = data[at + 10 : min(at + 10 + size, len(data))]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos, names, n = 0, {2: ("TT2", "TP1", "TAL")}.get(major, ("TIT2", "TPE1", "TALB")), 3 if major == 2 else 4
    if flags & 0x40 and major > 2 and len(body) >= 4:
        pos = _synchsafe(body) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if major == 2 else 10
    while pos + head <= len(body) and body[pos] != 0:
        raw = body[pos + n : pos + 2 * n]
        length = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        name, text = body[pos : pos + n].decode("latin-1"), body[pos + head : pos + head + length]
        if name in names and text:
            slot = ("title", "artist", "album")[names.index(name)]
            if getattr(out, slot) is None:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(text[0], "utf-8")
                setattr(out, slot, text[1:].decode(coding, "replace").split("\0")[0])
        pos += head + length
    return end


def _id3v1(data: bytes, out: Stream) -> None:
    for slot, a in (("title", 3), ("artist", 33), ("album", 63)):
        if getattr(out, slot) is None:
            setattr(out, slot, data[a : a + 30].split(b"\0")[0].decode("latin-1").rstrip() or None)


def _vbr(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame at ``at`` holds a table instead of sound; its fields go to ``out``."""
    pos = at + 4 + 2 * h.protected + h.side
    kind = data[pos : pos + 4]
    if kind not in (b"Xing", b"Info"):
        pos = at + 4 + 2 * h.protected + 32
        if data[pos : pos + 4] != b"VBRI" or len(data) < pos + 26:
            return False
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(data[pos + 10 : pos + 14], "big"), int.from_bytes(data[pos + 14 : pos + 18], "big")
        n, scale, size = (int.from_bytes(data[pos + k : pos + k + 2], "big") for k in (18, 20, 22))
        table = data[pos + 26 : pos + 26 + n * size]
        out.toc = [int.from_bytes(table[k : k + size], "big") * scale for k in range(0, len(table) - size + 1, size)] if size else []
        return True
    out.table, flags = kind.decode(), int.from_bytes(data[pos + 4 : pos + 8], "big")
    pos += 8
    if flags & 1:
        out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
    if flags & 2:
        out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
    if flags & 4:
        out.toc, pos = list(data[pos : pos + 100]), pos + 100
    pos += 4 * (flags >> 3 & 1)
    if data[pos : pos + 4] in (b"LAME", b"Lavf", b"Lavc") and len(data) >= pos + 24:
        v = int.from_bytes(data[pos + 21 : pos + 24], "big")
        out.delay, out.padding = v >> 12, v & 0xFFF
    return True


def _is_tag(data: bytes, at: int, end: int) -> bool:
    """Whether a whole header of an ID3v2 tag stands at ``at``: versions 2 to 4, and a size of four seven-bit bytes."""
    return data[at : at + 3] == b"ID3" and at + 10 <= end and 2 <= data[at + 3] <= 4 and max(data[at + 6 : at + 10]) < 128


#: Free-format frames are sought up to so many kilobits a second, twice the most that the tables name.
FREE_KBPS = 640


def _free_length(data: bytes, at: int, h: Header, end: int) -> int:
    """The length of a free-format frame: the distance to the next header that agrees, which is the same once more, or to the end."""
    end, whole = min(end, at + 125 * h.samples * FREE_KBPS // h.rate + 8), end
    k = data.find(b"\xff", at + 24, end)
    while k >= 0:
        g = header(data, k)
        if g and h.agrees(g):
            n = k - at - h.padding * (4 if h.layer == 1 else 1)
            after = k + n + g.padding * (4 if g.layer == 1 else 1)
            if after == whole or ((f := header(data, after)) and h.agrees(f)):
                return k - at
        k = data.find(b"\xff", k + 1, end)
    return 0


def parse(data: bytes | None) -> Stream | None:
    """What the bytes hold; None for null. Without a frame all numbers are 0 and the format is null.

    A frame counts if it is whole and, at the start or after a break, if its successor agrees with it, or if the data end
    or a tag with a whole header begins behind it. A frame with a bad checksum counts, and is counted among the bad. Frames of another version, layer or rate
    than the first are junk. The length of free-format frames is measured anew after every break; where that can't be
    done, it is the one before the break. ``n_resyncs`` is how often frames broke off before the end. Offsets are from the start of the data; a table's frame is not among them.
    """
    if data is None:
        return None
    out, end, pos = Stream(), len(data), 0
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
        end = max(0, end - size)
    first: Header | None = None
    synced, free, confirmed = False, 0, 0
    while pos < end:
        if _is_tag(data, pos, end):
            pos = _id3v2(data, pos, out)
            continue
        h = header(data, pos)
        n = 0
        if h and (first is None or first.agrees(h)):
            n = h.length
            if not n:
                padding = h.padding * (4 if h.layer == 1 else 1)
                free = free or max(0, _free_length(data, pos, h, end) - padding) or confirmed
                n = free + padding if free else 0
        if n and pos + n <= end:
            if not synced:
                g = header(data, pos + n)
                synced = pos + n == end or _is_tag(data, pos + n, end) or bool(g and h.agrees(g))
            if synced:
                confirmed = free
                if first is None:
                    first = h
                    out.version, out.layer, out.channels, out.sample_rate = {3: 1, 2: 2, 0: 25}[h.version], h.layer, h.channels, h.rate
                    if h.layer == 3 and _vbr(data, pos, h, out):
                        pos += n
                        continue
                if h.protected:
                    out.n_checked += 1
                    out.n_bad_checksums += not checksum(data, pos, h)
                out.offsets.append(pos)
                out.n_samples += h.samples
                pos += n
                continue
        if synced and first is not None:
            out.n_resyncs += 1
        synced, free = False, 0
        # The next byte that may begin a header or a tag.
        a = data.find(b"\xff", pos + 1, end)
        b = data.find(b"ID3", pos + 1, end if a < 0 else a)
        to = min((x for x in (a, b) if x >= 0), default=end)
        out.junk_bytes += to - pos
        pos = to
    if end < len(data) and data[len(data) - 128 : len(data) - 125] == b"TAG":
        _id3v1(data[len(data) - 128 :], out)
    out.n_frames = len(out.offsets)
    return out


_SCHEMA = "version int, layer int, channels int, sample_rate int, n_frames long, n_samples long, duration_us long, n_resyncs long, junk_bytes long, n_checked long, n_bad_checksums long, title string, artist string, album string, vbr_table string, table_frames long, table_bytes long, toc array<long>, frame_offsets array<long>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _row(s: Stream | None) -> tuple:
    if s is None:
        return (None,) * 19
    return (s.version, s.layer, s.channels, s.sample_rate, s.n_frames, s.n_samples, s.duration_us, s.n_resyncs, s.junk_bytes, s.n_checked, s.n_bad_checksums, s.title, s.artist, s.album, s.table, s.table_frames, s.table_bytes, s.toc, s.offsets)


def describe(media: DataFrame, *, id_col: str = "doc_id", data_col: str = "audio") -> DataFrame:
    """A row of facts for every row: format, frames, exact duration, tags, tables, checks and frame offsets.

    Null bytes give null facts; empty bytes and bytes without a frame give noughts and a null format. Repeated rows and
    null ids give a row each, so there are no ties to settle; an empty table gives no rows. Streams of any length are read
    whole, in time linear in it. Columns other than the two are ignored; a fact named like the id has underscores before it.
    """
    fields = [x.strip().rsplit(" ", 1) for x in _SCHEMA.replace(", ", ",").split(",")]

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = zip(*(_row(parse(x)) for x in b.column(1).to_pylist()))
            arrays = [pa.array(c, _TYPES[k]) for c, (_, k) in zip(cols, fields)]
            return pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["id", *(n for n, _ in fields)])

        return run

    return per_batch(media, [id_col, data_col], make, common.schema_of(id_col, media.schema[id_col].dataType.simpleString(), dict(fields)))


#: The made streams: kilobits of a cycle's frames, of layer III, MPEG 1, 44,100 a second, stereo.
CYCLE = (128, 96, 160)


def make_stream(text: str | None, number: int | None) -> bytes | None:
    """A test stream that carries all of a text's bytes, in frames after their side information.

    The tables have no column of sound, so the registered query makes one: a tag with a title, a variable-bitrate table,
    and frames whose bitrates run in a cycle. By the number's remainders: odd ones are protected, one frame in 7 then has
    a wrong checksum; every third stream has stray bytes before each eleventh frame.
    """
    if text is None:
        return None
    payload, number = text.encode("utf-8", "surrogatepass"), 0 if number is None else number
    protected, stray = number % 2 == 1, number % 3 == 0
    heads = [bytes((0xFF, 0xFA | (not protected), RATES[True, 3].index(k) << 4, 0)) for k in CYCLE]
    lengths = [header(h, 0).length for h in heads]
    skip = 36 + 2 * protected
    frames, at = [], 0
    while at < len(payload):
        k = len(frames) % len(CYCLE)
        part = payload[at : at + lengths[k] - skip]
        at += len(part)
        side = bytes((number + len(frames) + j) % 251 for j in (1, 2, 3)) + bytes(29)
        check = b""
        if protected:
            c = crc16(side, None, crc16(heads[k][2:4])) ^ (1 if len(frames) % 7 == 3 else 0)
            check = c.to_bytes(2, "big")
        frame = heads[k] + check + side + part.ljust(lengths[k] - skip, b"\0")
        frames.append((b"stray \xff bytes" if stray and len(frames) % 11 == 10 else b"") + frame)
    body = b"".join(frames)
    title = b"\x03" + f"stream {number}".encode()
    frame = b"TIT2" + len(title).to_bytes(4, "big") + b"\0\0" + title
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 127 for s in (21, 14, 7, 0)) + frame
    if not frames:
        return tag
    info = heads[0] + b"\0" * (34 if protected else 32) + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (len(body) + lengths[0]).to_bytes(4, "big") + bytes(min(255, k * 256 // 100) for k in range(100))
    return tag + info.ljust(lengths[0], b"\0") + body


def op7(spark, sf_dir: str) -> DataFrame:
    """The facts of one stream for each document, made of its whole text."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(make_stream, b.column(1).to_pylist(), b.column(0).to_pylist()), pa.binary())], names=["doc_id", "audio"])

        return run

    media = per_batch(common.table(spark, sf_dir, "documents"), ["doc_id", "text"], make, "doc_id long, audio binary")
    return describe(media).select("*", F.size("frame_offsets").alias("n_offsets"))
