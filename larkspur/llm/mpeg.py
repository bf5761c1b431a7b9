"""Media columns: byte payloads in MPEG audio streams.

A stream is an ID3v2.3 tag, a variable-bitrate table in a frame of its own and
MPEG-1 Layer III frames (48 kHz, mono, checksum). The frames' side information
declares no coded samples, so a player hears silence and the payload lies in the
frames' main data, byte for byte; the last frame takes the lowest bitrate that
holds the rest. The tag records payload length and CRC-32.

The reader is general: it reads ID3v2 tags and, where the last frame has ended, an ID3v1 tag, finds frame headers by their
sync word and confirms each by the header after it, resynchronises after damage,
reads Xing, Info and VBRI tables, checks the CRC-16 of protected frames, and gives
the exact duration and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.words import slices
from larkspur.shared import materialise

UNIT = 64

# Fixed values of the MPEG audio formats.
#: Bitrates in kbit/s by (MPEG-1, layer) and header index 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Sampling rates by version bits (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ (CRC_POLYNOMIAL if value & 0x8000 else 0)) & 0xFFFF
        table.append(value)
    return table


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    value = CRC_START
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC_TABLE[value >> 8 ^ byte]
    return value


@dataclass(slots=True)
class Header:
    """What a frame header says."""

    mpeg1: bool
    layer: int
    protected: bool
    rate: int
    bitrate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)


_HEADERS: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """Reads four bytes; None if they are no frame header (free format included)."""
    if raw in _HEADERS:
        return _HEADERS[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] >= 0xE0:
        version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
        index, rate = raw[2] >> 4, raw[2] >> 2 & 3
        if version != 1 and layer < 4 and 0 < index < 15 and rate < 3 and raw[3] & 3 != 2:
            mpeg1, padding, hertz = version == 3, raw[2] >> 1 & 1, RATES[version][rate]
            bits = BITRATES[mpeg1, layer][index - 1] * 1000
            samples = 384 if layer == 1 else 576 if layer == 3 and not mpeg1 else 1152
            size = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
            found = Header(mpeg1, layer, not raw[1] & 1, hertz, bits, raw[3] >> 6 == 3, size, samples)
    if len(_HEADERS) < 100_000:
        _HEADERS[raw] = found
    return found


def synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _prefixes() -> list[tuple[int, bytes]]:
    """(main data bytes, header + checksum + side information) of each bitrate."""
    out = []
    for index in range(1, 15):
        head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
        side = bytes(17)
        out.append((header(head).size - 23, head + crc16(head[2:] + side).to_bytes(2, "big") + side))
    return out


PREFIXES = _prefixes()
ROOM, FULL = PREFIXES[-1]


def text_frame(name: str, value: str) -> bytes:
    """An ID3v2.3 user text frame."""
    body = b"\0" + name.encode("latin-1") + b"\0" + value.encode("latin-1")
    return b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body


def write(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds the payload; ``n_bytes`` of it are data, the rest padding."""
    frames = [FULL + payload[at : at + ROOM] for at in range(0, len(payload) - ROOM + 1, ROOM)]
    if rest := payload[len(frames) * ROOM :]:
        room, head = next(p for p in PREFIXES if p[0] >= len(rest))
        frames.append(head + rest + bytes(room - len(rest)))
    tag = text_frame("data_bytes", str(n_bytes)) + text_frame("payload_bytes", str(len(payload))) + text_frame("payload_crc32", str(zlib.crc32(payload)))
    total = sum(map(len, frames))
    table = bytes(_percent_table([len(f) for f in frames], total))
    body = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (total + 576).to_bytes(4, "big") + table
    head = bytes([0xFF, 0xFB, 11 << 4 | 1 << 2, 0xC0])  # 192 kbit/s, not protected: 576 bytes
    first = head + bytes(17) + body
    return b"ID3\x03\0\0" + synchsafe(len(tag)) + tag + first + bytes(576 - len(first)) + b"".join(frames)


def _percent_table(sizes: list[int], total: int) -> list[int]:
    """256ths of the file at each hundredth of the duration."""
    offsets, at = [], 0
    for size in sizes:
        offsets.append(at)
        at += size
    return [min(255, 256 * (offsets[p * len(sizes) // 100] if sizes else 0) // max(total, 1)) for p in range(100)]


@dataclass
class Stream:
    """What a reader finds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bits: int = 0
    skipped: int = 0
    checked: int = 0
    wrong: int = 0
    data: bytes = b""

    @property
    def duration(self) -> Fraction:
        """Exact seconds, without the frame of the variable-bitrate table."""
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)

    def seek(self, step: int = 1) -> list[int]:
        """Offsets of the frames that play at every ``step`` seconds."""
        if not self.offsets or not self.samples:
            return []
        each = self.samples // len(self.offsets)
        return [self.offsets[min(s * self.rate // each, len(self.offsets) - 1)] for s in range(0, int(self.duration) + 1, step)]


def _tags(raw: bytes) -> tuple[dict[str, str], int]:
    """Texts of the leading tags and where the audio starts."""
    tags, start = {}, 0
    while raw[start : start + 3] == b"ID3" and len(raw) >= start + 10:
        size = 0
        for byte in raw[start + 6 : start + 10]:
            size = size << 7 | byte & 0x7F
        at, end = start + 10, min(start + 10 + size, len(raw))
        while at + 10 <= end and raw[at : at + 4].isalnum():
            length = int.from_bytes(raw[at + 4 : at + 8], "big")
            body = raw[at + 10 : at + 10 + length]
            if raw[at : at + 4] == b"TXXX":
                name, _, value = body[1:].partition(b"\0")
                tags[name.decode("latin-1")] = value.decode("latin-1")
            elif raw[at : at + 1] == b"T":
                tags[raw[at : at + 4].decode()] = body[1:].decode("latin-1").rstrip("\0")
            at += 10 + length
        start = end + 10 * bool(raw[start + 5] & 0x10)
    return tags, start


def _last_tag(raw: bytes, at: int) -> dict[str, str] | None:
    """Texts of an ID3v1 tag. It counts only where a frame has ended: inside frames the same bytes are data."""
    if at != len(raw) - 128 or raw[at : at + 3] != b"TAG":
        return None
    return {k: v for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)) if (v := raw[at + a : at + b].decode("latin-1").rstrip("\0 "))}


def _table(frame: bytes, info: Header) -> dict:
    """The variable-bitrate table of a frame, if it holds one."""
    at = 4 + 2 * info.protected + info.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        return out | ({"seek": list(frame[at : at + 100])} if flags & 4 else {})
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return {}


def read(raw: bytes) -> Stream:
    """Reads a stream; damaged parts are skipped and counted."""
    out = Stream()
    (out.tags, at), stop = _tags(raw), len(raw)
    kept, good = [], {}
    while at + 4 <= stop:
        if (last := _last_tag(raw, at)) is not None:
            out.tags, at = out.tags | last, stop
            break
        info = header(raw[at : at + 4])
        end = at + info.size if info else 0
        start = at + 4 + 2 * info.protected + info.side * (info.layer == 3) if info else at
        sound = None
        if info and end <= stop and info.protected and info.layer == 3:
            covered = raw[at + 2 : at + 4] + raw[at + 6 : start]
            if (value := good.get(covered)) is None:
                value = crc16(covered)
                if len(good) < 10_000:
                    good[covered] = value
            sound = value == int.from_bytes(raw[at + 4 : at + 6], "big")
        # a header counts if its checksum holds, or its frame ends where another begins or the stream does
        if not info or end > stop or not sound and end + 4 <= stop and header(raw[end : end + 4]) is None and _last_tag(raw, end) is None:
            found = raw.find(b"\xff", at + 1, stop)
            found = stop if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        if sound is not None:
            out.checked += 1
            out.wrong += not sound
        if not out.offsets and not out.table and (table := _table(raw[at:end], info)):
            out.table = table
        else:
            out.offsets.append(at)
            out.samples += info.samples
            out.bits += info.bitrate
            out.rate = out.rate or info.rate
            kept.append(raw[start:end])
        at = end
    out.skipped += max(0, stop - at)
    out.data = b"".join(kept)
    return out


def payload_of(stream: Stream) -> tuple[bytes, int]:
    """The payload and its data bytes, verified against the tag."""
    own = [stream.tags.get(k, "") for k in ("payload_bytes", "payload_crc32", "data_bytes")]
    if not all(x.isdecimal() for x in own):
        raise ValueError("the stream holds no payload")
    size, crc, data = map(int, own)
    payload = stream.data[:size]
    if stream.wrong or len(payload) != size or zlib.crc32(payload) != crc:
        raise ValueError("the stream is damaged")
    return payload, data


def feature(stream: Stream) -> str:
    """Duration, bitrate, tables and seek offsets as text."""
    offsets = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in stream.offsets))
    mean = stream.bits // max(len(stream.offsets), 1)
    return f"table={stream.table.get('kind', 'none')};frames={len(stream.offsets)};samples={stream.samples};rate={stream.rate};seconds={stream.duration};mean_bitrate={mean};checked={stream.checked};wrong={stream.wrong};skipped={stream.skipped};offsets_crc32={offsets};seek={','.join(map(str, stream.seek()))}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every document, text as UTF-8 with zero bytes up to a positive multiple of UNIT.

    Null texts are empty; equal texts give equal streams; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in slices(texts):
                media = [write(t + bytes(-len(t) % UNIT if t else UNIT), len(t)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate long, frame_offsets array<long>, problem string"


def described(raw: bytes | None) -> tuple:
    """What :func:`describe` says of one stream."""
    if raw is None:
        return (None,) * 10 + ("no media",)
    stream = read(raw)
    try:
        payload, n_bytes = payload_of(stream)
        own, problem = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])), None
    except ValueError as e:
        own, problem = (None,) * 4, str(e)
    return (*own, len(raw), hashlib.sha256(raw).hexdigest(), feature(stream), stream.samples, stream.rate, stream.offsets, problem)


def describe(media: DataFrame) -> DataFrame:
    """Reads stored streams back: digests, features and the offset of every frame, one row each.

    The exact duration is ``duration_samples / sample_rate`` seconds. A stream without
    a payload of ours (foreign, damaged or cut) has null payload columns and says so in
    ``problem``, as does a null one; its frames are told all the same. Equal streams
    give equal values; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.list_(pa.int64()) if c.endswith("array<long>") else pa.int64() for c in DIGESTS.split(", ")]
        for batch in batches:
            out = [(doc, *described(raw.as_py())) for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, DIGESTS)


def media_table(docs: DataFrame) -> DataFrame:
    """The stored streams, written to the shared folder and read back."""
    return materialise(store(docs), "media")
