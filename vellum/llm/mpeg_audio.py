"""Media columns: MPEG audio.

``pack`` stores bytes losslessly in an MPEG-2 Layer III stream (16 kHz, mono,
protected): a frame stands for 576 samples and carries 576 bytes of payload as
ancillary data behind an empty granule, so a byte is a sample of the format.
The stream starts with an ID3v2 tag and a frame with a Xing table (frames,
bytes, seek table of 100 entries) and ends with an ID3v1 tag.

``read`` takes any MPEG audio stream: it skips ID3v2 and ID3v1 tags,
synchronises by header, frame length and the next header, resynchronises after
junk, reads Xing/Info and VBRI tables, verifies the CRC-16 of protected
frames, and gives exact durations (samples and rate) and the byte offset of
every frame.

A null or an empty text is stored as one frame of bytes 255.  Rows are
independent and stay as they are, with repeated, null or great ids; equal texts
give equal values; an empty table gives an empty one; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import mapped, small_batches

UNIT = 576
#: kbit/s by index, for MPEG-1 and for MPEG-2/2.5, by layer (fixed values of the format).
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    """What four header bytes say; ``size`` is the length of the frame in bytes."""

    version: float
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The header in four bytes, or None; free-format streams aren't read."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate, hertz = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or hertz == 3 or four[3] & 3 == 2:
        return None
    kbps = _RATES[1 if version == 1 else 2, layer][rate]
    hz = _HERTZ[hertz] // {1: 1, 2: 2, 2.5: 4}[version]
    pad = four[2] >> 1 & 1
    if layer == 1:
        size, samples = (12 * kbps * 1000 // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples // 8 * kbps * 1000 // hz + pad
    return Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, size, samples)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, bits from the left."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


#: MPEG-2, Layer III, protected, 144 kbit/s, 16 kHz, no padding, mono.
_HEAD = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_FRAME = header(_HEAD)
_SIDE = bytes(9)
_LEAD = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + _SIDE)) + _SIDE
_REST = bytes(_FRAME.size - len(_LEAD) - UNIT)


def pack(payload: bytes) -> bytes:
    """An MPEG audio stream that holds ``payload``, whose length is a multiple of 576."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    audio = (n + 1) * _FRAME.size
    toc = bytes(min(255, (i * n // 100 + 1) * _FRAME.size * 256 // audio) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, audio) + toc
    text = b"\x03" + b"payload"
    tag_frame = b"TIT2" + _syncsafe(len(text)) + b"\0\0" + text
    out = [b"ID3\x04\0\0" + _syncsafe(len(tag_frame)) + tag_frame, _LEAD, table, bytes(_FRAME.size - len(_LEAD) - len(table))]
    frames = np.zeros((n, _FRAME.size), np.uint8)
    frames[:, : len(_LEAD)] = np.frombuffer(_LEAD, np.uint8)
    frames[:, len(_LEAD) : len(_LEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    out += [frames.tobytes(), b"TAG" + b"payload".ljust(125, b"\0")]
    return b"".join(out)


@dataclass
class Stream:
    """What ``read`` finds in a stream."""

    tags: list[str] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    toc: tuple[int, ...] = ()

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.heads)

    @property
    def duration_us(self) -> int:
        """Microseconds, rounded down, from exact sample counts."""
        by: dict[int, int] = {}
        for h in self.heads:
            by[h.hertz] = by.get(h.hertz, 0) + h.samples
        return sum(1_000_000 * n // hz for hz, n in sorted(by.items()))


def _bounds(data: bytes) -> tuple[int, int, list[str]]:
    at, end, tags = 0, len(data), []
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = 0
        for b in data[at + 6 : at + 10]:
            size = size << 7 | b & 127
        tags.append(f"ID3v2.{data[at + 3]}")
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags.append("ID3v1")
        end -= 128
    return min(at, end), end, tags


def _table(s: Stream, data: bytes, at: int, h: Header) -> bool:
    """Reads a Xing, Info or VBRI table in the frame at ``at``; False if it holds none."""
    x = at + 4 + 2 * h.protected + h.side
    name = data[x : x + 4]
    if name in (b"Xing", b"Info"):
        s.table = name.decode()
        flags = int.from_bytes(data[x + 4 : x + 8], "big")
        x += 8
        if flags & 1:
            s.table_frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 2:
            s.table_bytes, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 4:
            s.toc = tuple(data[x : x + 100])
        return True
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        s.table = "VBRI"
        s.table_bytes, s.table_frames = struct.unpack(">II", data[x + 10 : x + 18])
        entries, scale, width = struct.unpack(">HHH", data[x + 18 : x + 24])
        s.toc = tuple(scale * int.from_bytes(data[x + 26 + i * width : x + 26 + (i + 1) * width], "big") for i in range(entries))
        return True
    return False


def read(data: bytes) -> Stream:
    """Parses a whole stream; bytes that are no frame are counted as skipped."""
    at, end, tags = _bounds(data)
    s, synced = Stream(tags), False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end:
            h = None
        elif not synced:  # a header alone can be chance: the next one has to follow, or the end
            nxt = at + h.size
            other = header(data[nxt : nxt + 4])
            if nxt != end and (other is None or (other.version, other.layer, other.hertz) != (h.version, h.layer, h.hertz)):
                h = None
        if h is None:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            s.skipped, at, synced = s.skipped + found - at, found, False
            continue
        synced = True
        if h.protected and h.layer == 3:
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            s.crc_ok, s.crc_bad = s.crc_ok + good, s.crc_bad + (not good)
        if s.offsets or s.table or not (h.layer == 3 and _table(s, data, at, h)):
            s.offsets.append(at)
            s.heads.append(h)
        at += h.size
    s.skipped += max(0, end - at)
    return s


def unpack(data: bytes, stream: Stream) -> bytes:
    """The payload that ``pack`` stored."""
    lead = len(_LEAD)
    return b"".join([data[o + lead : o + lead + UNIT] for o in stream.offsets])


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def feature(s: Stream) -> str:
    """Durations, tables, checks and the seek offsets (their count, last one and CRC-32)."""
    h = s.heads[0] if s.heads else None
    seeks = np.array(s.offsets, "<u8").tobytes()
    return (
        f"mpeg{h.version if h else '?'}l{h.layer if h else '?'};hz={h.hertz if h else 0};kbps={h.kbps if h else 0};frames={len(s.offsets)};samples={s.samples};us={s.duration_us}"
        f";tags={'+'.join(s.tags)};table={s.table}:{s.table_frames}:{s.table_bytes}:{len(s.toc)};crc={s.crc_ok}/{s.crc_ok + s.crc_bad};skipped={s.skipped}"
        f";seek={s.offsets[-1] if s.offsets else -1}:{zlib.crc32(seeks)}"
    )


def media_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``media`` (the stream that holds the text's bytes)."""

    def row(text: str) -> tuple[int, bytes]:
        raw = text.encode()
        return len(raw), pack(padded(raw))

    return mapped(df, id_col, text_col, "n_bytes long, media binary", row)


def media_index(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Durations, seek offsets, tags and checks of every stream; a null stream has no frames."""
    small_batches(df.sparkSession)
    schema = "frames long, samples long, hertz int, duration_us long, tags array<string>, vbr_table string, crc_ok long, crc_bad long, skipped_bytes long, seek_offsets array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(data: bytes | None) -> tuple:
        s = read(bytes(data or b""))
        return len(s.offsets), s.samples, s.heads[0].hertz if s.heads else None, s.duration_us, s.tags, s.table or None, s.crc_ok, s.crc_bad, s.skipped, s.offsets

    @F.pandas_udf(schema)
    def rows(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(m) for m in batch], columns=names).astype({"hertz": "Int32"})

    return df.select(F.col(id_col).alias("_id"), rows(F.col(media_col)).alias("_row")).select(F.col("_id").cast("long").alias(id_col), "_row.*")


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back, and returns digests and features.

    ``n_bytes`` is the text's, ``payload_*`` and ``tail_crc32`` are of the
    payload as read back, ``media_*`` of the stored stream.  A stream is made
    and read row by row, so a worker holds one at a time.
    """

    def row(text: str) -> tuple:
        raw = text.encode()
        media = pack(padded(raw))
        s = read(media)
        back = unpack(media, s)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)

    return mapped(df, id_col, text_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)
