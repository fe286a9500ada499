"""MPEG audio columns: frames, tags, checksums, durations and seek offsets.

``probe`` parses MPEG-1/2/2.5 audio (any layer): it skips ID3v2 and ID3v1 tags,
walks frame headers, resynchronises after damage (a header counts only if its
checksum fits and another header or the end follows where it says), reads
Xing/Info and VBRI tables with their seek tables and verifies CRC-16 where a
Layer I or III frame has one (what a Layer II checksum covers depends on its
allocation tables, which are not read; such frames count as not checked).

``media_table`` stores audio with its columns: exact duration, frames, the byte
offset of every frame for seeking, tags and the verdict of the checksums.

``store`` keeps a byte payload losslessly as the main data of MPEG-1 Layer III
frames (48 kHz, mono, with checksums) behind an ID3v2 tag and a Xing frame with
its seek table; ``payload`` of a probe is what the frames hold.

Both are maps over rows: nothing is shuffled and no row needs another.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import written

# Fixed values of the format: kbit/s by index 1 to 14, and samples a second.
RATES_V1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_V2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64
_SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
_HEAD = 4 + 2 + _SIDE

PROBE = T.StructType(
    [
        T.StructField("frames", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("vbr_frames", T.LongType()),
        T.StructField("crc_checked", T.LongType()),
        T.StructField("crc_errors", T.LongType()),
        T.StructField("resyncs", T.LongType()),
        T.StructField("skipped_bytes", T.LongType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seek_offsets", T.ArrayType(T.LongType())),
        T.StructField("table_offsets", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        out.append(crc)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    kbps: int
    rate: int
    size: int
    samples: int
    protected: bool
    side: int
    checked: int | None

    @property
    def kind(self) -> tuple[int, int, int]:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None (free-format frames are not taken)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_at = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_at == 3 or word[3] & 3 == 2:
        return None
    kbps = (RATES_V1 if version == 3 else RATES_V2)[layer][index - 1]
    rate, pad = SAMPLE_RATES[version][rate_at], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = word[3] >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    # Layer I: four bits of allocation for each channel's subbands; of joint stereo those above the bound are shared
    bound = 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32
    allocated = 16 if mono else (32 + bound) // 2
    return Header(version, layer, kbps, rate, size, samples, not word[1] & 1, side if layer == 3 else 0, {1: allocated, 3: side}.get(layer))


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _id3(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2.3 or 2.4 tag at the start, and where audio starts."""
    if len(data) < 10 or data[:3] != b"ID3":
        return {}, 0
    end, at, tags = min(len(data), 10 + _synchsafe(data[6:10])), 10, {}
    while at + 10 <= end and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        size = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body, at = data[at + 10 : min(end, at + 10 + size)], at + 10 + size
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text.rstrip("\0")
    return tags, end


def _vbr(frame: bytes, h: Header) -> tuple[dict[str, str], list[int]] | None:
    """The Xing, Info or VBRI table of a frame, if it is one, with its seek table as bytes from the frame's start."""
    for start in (4 + h.side, 6 + h.side):
        if frame[start : start + 4] in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8, {"vbr": frame[start : start + 4].decode()}
            for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
                if flags & bit:
                    out[name], at = str(int.from_bytes(frame[at : at + 4], "big")), at + 4
            toc = frame[at : at + 100] if flags & 4 and "vbr_bytes" in out else b""
            return out, [point * int(out["vbr_bytes"]) // 256 for point in toc]
    if frame[36:40] == b"VBRI":
        number = lambda a, b: int.from_bytes(frame[a:b], "big")
        entries, scale, width = number(54, 56), number(56, 58), number(58, 60)
        steps = [number(62 + width * k, 62 + width * (k + 1)) * scale for k in range(entries)] if 62 + width * entries <= len(frame) else []
        return {"vbr": "VBRI", "vbr_bytes": str(number(46, 50)), "vbr_frames": str(number(50, 54))}, list(accumulate(steps))
    return None


@dataclass
class Probe:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    table: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    crc_checked: int = 0
    crc_errors: int = 0
    resyncs: int = 0
    skipped: int = 0
    payload: bytes = b""


def _crc_fits(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a Layer I or III frame's checksum fits; None if it has none."""
    if not h.protected or h.checked is None:
        return None
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.checked]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _followed(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether the end or a frame of the same kind follows a frame."""
    after = header(data[at + h.size : at + h.size + 4])
    return at + h.size == end or (after is not None and after.kind == h.kind)


def _next_sync(data: bytes, at: int, end: int) -> int:
    """Where the next believable frame starts, or ``end``."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        h = header(data[at : at + 4])
        if h and at + h.size <= end and _crc_fits(data, at, h) is not False and _followed(data, at, h, end):
            return at
        at += 1
    return end


def probe_bytes(data: bytes | None) -> Probe:
    """All that can be read from MPEG audio; an empty probe for null, empty or foreign bytes."""
    out = Probe()
    if not data:
        return out
    out.tags, at = _id3(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    first, kind, parts = True, None, []
    while at < end:
        h = header(data[at : at + 4])
        inside = h is not None and at + h.size <= end
        fits = _crc_fits(data, at, h) if inside else None
        # a frame is believed for its checksum, for what follows it, or, if it has no checksum, for being like those before
        if not (inside and (fits or _followed(data, at, h, end) or (fits is None and h.kind == kind))):
            found = _next_sync(data, at + 1, end)
            out.resyncs, out.skipped, at = out.resyncs + 1, out.skipped + found - at, found
            continue
        if fits is not None:
            out.crc_checked += 1
            out.crc_errors += fits is False
        table = _vbr(data[at : at + h.size], h) if first else None
        first = False
        if table:
            out.tags |= table[0]
            out.table = [at + step for step in table[1]]
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.rate = h.rate
            parts.append(data[at + 4 + 2 * h.protected + h.side : at + h.size])
        at, kind = at + h.size, h.kind
    body = b"".join(parts)
    out.payload = body[: int(out.tags["payload-bytes"])] if out.tags.get("payload-bytes", "").isdigit() else body
    return out


def _frame_head(kbps: int, body: int) -> bytes:
    """Header, checksum and side information of a 48 kHz mono frame with ``body`` bytes of main data."""
    word = bytes((0xFF, 0xFA, (RATES_V1[3].index(kbps) + 1) << 4 | 1 << 2, 0xC0))
    bits = 8 * body
    lengths = (min(bits, 4095), bits - min(bits, 4095))
    # 18 bits before the granules; 59 bits a granule, of which the first 12 are its length
    side = ((lengths[0] << 47) << 59 | lengths[1] << 47).to_bytes(_SIDE, "big")
    return word + struct.pack(">H", crc16(word[2:4] + side)) + side


_SIZES = {kbps: 3 * kbps for kbps in RATES_V1[3]}
_FULL = _SIZES[320] - _HEAD
_HEADS = {kbps: _frame_head(kbps, size - _HEAD) for kbps, size in _SIZES.items()}


def _text_frame(name: str, text: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + text.encode()
    return b"TXXX" + struct.pack(">IH", len(body), 0) + body


def store_bytes(data: bytes) -> bytes:
    """Audio whose frames hold data and zeros up to a positive multiple of 64."""
    payload = data + bytes(-len(data) % UNIT if data else UNIT)
    head, parts = _HEADS[320], []
    full = len(payload) // _FULL
    for at in range(0, full * _FULL, _FULL):
        parts += (head, payload[at : at + _FULL])
    if rest := payload[full * _FULL :]:
        kbps = next(k for k, size in _SIZES.items() if size - _HEAD >= len(rest))
        parts += (_HEADS[kbps], rest.ljust(_SIZES[kbps] - _HEAD, b"\0"))
    audio = b"".join(parts)
    frames = full + bool(rest)
    tags = _text_frame("payload-bytes", str(len(payload))) + _text_frame("text-bytes", str(len(data)))
    size = len(tags)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tags
    total = _SIZES[128] + len(audio)
    at_percent = [min(255, (_SIZES[128] + frames * p // 100 * _SIZES[320]) * 256 // total) for p in range(100)]
    xing = b"Xing" + struct.pack(">III", 7, frames, total) + bytes(at_percent)
    return tag + _HEADS[128] + xing.ljust(_SIZES[128] - _HEAD, b"\0") + audio


def store(data: Column) -> Column:
    """Audio bytes that hold a binary column; null counts as empty."""

    @F.pandas_udf(T.BinaryType())
    def mpeg_store(values: pd.Series) -> pd.Series:
        return values.map(lambda v: store_bytes(bytes(v) if v is not None else b""))

    return mpeg_store(data)


def probe(media: Column) -> Column:
    """PROBE struct of a binary column; bytes without frames give zeros and an empty payload."""

    @F.pandas_udf(PROBE)
    def mpeg_probe(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            p = probe_bytes(bytes(v) if v is not None else None)
            declared = p.tags.get("vbr_frames", "")
            rows.append((len(p.offsets), p.samples, p.rate, p.samples / p.rate if p.rate else 0.0, int(declared) if declared.isdigit() else None, p.crc_checked, p.crc_errors, p.resyncs, p.skipped, p.tags, p.offsets, p.table, p.payload))
        out = pd.DataFrame(rows, columns=PROBE.names)
        return out.astype({"vbr_frames": "Int64"})

    return mpeg_probe(media)


#: Columns that a media table has beside id and media.
MEDIA_COLUMNS = ("duration_s", "frames", "samples", "sample_rate", "seek_offsets", "table_offsets", "tags", "crc_checked", "crc_errors")


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of id, media (the audio that holds each whole text) and MEDIA_COLUMNS; one row for each row of docs.

    Null texts count as empty; repeated rows stay; columns beside id and text
    are not looked at.  An empty table gives an empty one.
    """
    data = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    made = docs.select(F.col(id_col), store(data).alias("media")).withColumn("_probe", probe(F.col("media")))
    return written(made.select(id_col, "media", *[F.col(f"_probe.{c}") for c in MEDIA_COLUMNS]), "media")
