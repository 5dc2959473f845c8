"""MPEG audio in binary columns (operator 4): storing, resynchronising, tags, Xing and VBRI tables, checksums, seek offsets."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates (kbit/s) by index 1-14, sample rates by index.
BITRATES = {
    ("1", 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    ("1", 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    ("1", 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    ("2", 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    ("2", 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    ("2", 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {"1": [44100, 48000, 32000], "2": [22050, 24000, 16000], "2.5": [11025, 12000, 8000]}

UNIT = 192  # payload bytes that a 240-byte frame carries
SMALL = bytes([0xFF, 0xFA, 0x64, 0xC4])  # MPEG-1 layer III, checksum, 80 kbit/s, 48 kHz, mono: 240 bytes
LARGE = bytes([0xFF, 0xFA, 0xE4, 0xC4])  # the same at 320 kbit/s: 960 bytes, four units
INFO = bytes([0xFF, 0xFB, 0x64, 0xC4])  # without a checksum: carries the Xing table
SIDE = 17  # bytes of mono side information; all zero is silence, the rest of a frame is ancillary data


# Fixed values of the same standards: bits of the allocation field of each layer II subband, by table.
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "lsf": [4] * 4 + [3] * 7 + [2] * 19,
}


@dataclass(frozen=True)
class Header:
    length: int
    samples: int
    hz: int
    checked: bool  # a checksum follows the header
    stream: tuple[str, int, int]  # version, layer and sample rate: the same in all frames of a stream
    mono: bool
    bound: int  # subbands from here on share their allocation between the channels
    side: int  # bytes of layer III side information
    table: str  # allocation table of layer II

    @property
    def layer(self) -> int:
        return self.stream[1]


@lru_cache(maxsize=4096)
def frame_header(head: bytes) -> Header | None:
    """What a 4-byte header says; None if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(head[1] >> 3 & 3)
    layer = 4 - (head[1] >> 1 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbit, hz, pad = BITRATES["1" if version == "1" else "2", layer][index - 1], RATES[version][rate], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    length = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    mode = head[3] >> 6
    mono, bound = mode == 3, 4 * (1 + (head[3] >> 4 & 3)) if mode == 1 else 32
    side = {("1", False): 32, ("1", True): 17}.get((version, mono), 9 if mono else 17)
    share = kbit if mono else kbit // 2
    table = "lsf" if version != "1" else "a" if 56 <= share and (share <= 80 or hz == 48000) else "b" if share >= 96 else "d" if hz == 32000 else "c"
    return Header(length, samples, hz, not head[1] & 1, (version, layer, hz), mono, bound, side, table)


def covered_bits(h: Header, body: bytes) -> int:
    """How many bits of a frame's body its checksum covers: side information, or allocations (and scale factor choices in layer II)."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * 32 if h.mono else 4 * (h.bound + 32)
    bits, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(ALLOCATION[h.table]):
        channels = 1 if h.mono else 2
        for _ in range(1 if band >= h.bound else channels):
            allocated = bits >> 512 - at - width & (1 << width) - 1
            at += width
            chosen += 2 * (allocated > 0) * (channels if band >= h.bound else 1)
    return at + chosen


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of MPEG audio over the first `bits` of data: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        high = (crc >> 15) ^ (data[k >> 3] >> (7 - (k & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if high else 0)
    return crc


def checksum_ok(h: Header, frame: bytes) -> bool:
    """Whether a frame with a checksum agrees with it; the last two bytes of the header are covered too."""
    bits = covered_bits(h, frame[6:])
    covered = frame[2:4] + frame[6 : 6 + -(-bits // 8)]
    return 16 + bits <= 8 * len(covered) and crc16(covered, 16 + bits) == int.from_bytes(frame[4:6], "big")


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A tagged variable-bitrate layer III stream that holds `payload` (whole units) as ancillary data."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    large, small = divmod(len(units), 4)
    parts = []
    for head, count, per, size in ((LARGE, large, 4, 960), (SMALL, small, 1, 240)):
        frames = np.zeros((count, size), np.uint8)
        start = 0 if head is LARGE else 4 * large
        frames[:, :4] = list(head)
        frames[:, 4:6] = list(struct.pack(">H", crc16(head[2:] + bytes(SIDE))))
        frames[:, 6 + SIDE : 6 + SIDE + per * UNIT] = units[start : start + count * per].reshape(count, per * UNIT)
        parts.append(frames.tobytes())
    audio = b"".join(parts)
    offsets = np.concatenate([np.arange(large) * 960, 960 * large + np.arange(small) * 240]) + 240
    total = 240 + len(audio)
    toc = bytes(int(256 * offsets[k * len(offsets) // 100] // total) for k in range(100))
    xing = b"Xing" + struct.pack(">III", 0x0F, len(offsets), total) + toc + struct.pack(">I", 0)
    info = (INFO + bytes(SIDE) + xing).ljust(240, b"\0")
    text = b"\x03n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + info + audio


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def number(b: bytes, bits: int = 8) -> int:
    """A big-endian number of bytes that carry 8 or (syncsafe) 7 bits each."""
    out = 0
    for byte in b:
        out = out << bits | byte & (1 << bits) - 1
    return out


def tag_texts(data: bytes) -> tuple[dict[str, str], int]:
    """Texts of a leading ID3v2 tag (those of a user by their description) and the offset behind it.

    Frame sizes carry 7 bits a byte in version 2.4, 8 in 2.3 and 2.2; the last has names
    and sizes of three bytes. Extended headers are skipped, unsynchronised tags restored.
    """
    found: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return found, 0
    version, flags, size = data[3], data[5], number(data[6:10], 7)
    end, body = 10 + size + 10 * (version == 4 and flags >> 4 & 1), data[10 : 10 + size]
    if flags >> 7 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags >> 6 & 1 and version > 2:
        at = number(body[:4], 7) if version == 4 else 4 + number(body[:4])
    wide, bits = (3, 8) if version == 2 else (4, 7 if version == 4 else 8)
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at] != 0:
        name, length = body[at : at + wide].decode("latin-1"), number(body[at + wide : at + 2 * wide], bits)
        value = body[at + head : at + head + length]
        if version == 4 and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if version == 4 and body[at + 9] & 1:
            value = value[4:]  # the length before unsynchronising
        if name[0] == "T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
            key, _, told = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            found[key] = told.lstrip("\ufeff")
        at += head + length
    return found, end


def parse(data: bytes) -> dict:
    """Tags, Xing or VBRI table, frame offsets, samples and checksum results of one stream.

    A header counts if it follows a frame of the same stream, or if another of the stream
    follows at its length (or the data or an ID3v1 tag end there); else the scan goes on
    at the next 0xFF byte.
    'TAG' at 128 bytes before the end is an ID3v1 tag unless a frame's data run over that
    place.
    Broken or empty data gives no frames.
    """
    tags, at = tag_texts(data)
    found, tag = walk(data, at, len(data)), len(data) - 128
    if data[-128:-125] == b"TAG" and not any(o < tag < o + n for o, n in zip(found["offsets"], found["lengths"], strict=True)):
        found = walk(data, at, tag)
    return {"tags": tags} | found


def walk(data: bytes, at: int, end: int) -> dict:
    """What `parse` finds in the frames between two places."""
    offsets, lengths, samples, hz, good, bad, skipped, table, stream, due = [], [], 0, 0, 0, 0, 0, None, None, -1
    while 0 <= at and at + 4 <= end:
        h = frame_header(data[at : at + 4])
        ok = h is not None and at + h.length <= end and stream in (None, h.stream)
        if ok and at != due and at + h.length + 4 <= end:
            after = frame_header(data[at + h.length : at + h.length + 4])
            ok = after is not None and after.stream == h.stream
        if not ok:
            to = data.find(b"\xff", at + 1, end)
            skipped += (end if to < 0 else to) - at
            at = to
            continue
        stream, hz = h.stream, h.hz
        if not offsets and table is None and (table := rate_table(h, data[at : at + h.length])):
            at = due = at + h.length
            continue
        offsets.append(at)
        lengths.append(h.length)
        samples += h.samples
        if h.checked:
            # layer III covers so few bytes that equal ones are remembered
            same = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == number(data[at + 4 : at + 6]) if h.layer == 3 else checksum_ok(h, data[at : at + h.length])
            good, bad = good + same, bad + (not same)
        at = due = at + h.length
    cut = (table or {}).get("delay", 0) + (table or {}).get("padding", 0)
    return {"table": table, "offsets": offsets, "lengths": lengths, "samples": samples, "played": max(0, samples - cut), "hz": hz, "crc_ok": good, "crc_bad": bad, "skipped": skipped, "stream": stream}


def rate_table(h: Header, frame: bytes) -> dict | None:
    """Frames, bytes and seek points of a variable-bitrate header in a first frame: Xing/Info (100 shares of 256) or VBRI (byte offsets).

    Parts that are not there are None. delay and padding: samples that an encoder says it
    put before and behind, 0 if it says nothing.
    """
    if h.layer != 3:
        return None
    at = 4 + 2 * h.checked + h.side
    out = {"kind": frame[at : at + 4].decode("latin-1"), "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0}
    if out["kind"] in ("Xing", "Info"):
        flags, at = number(frame[at + 4 : at + 8]), at + 8
        for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                part = frame[at : at + size]
                out[key] = list(part) if key == "toc" else number(part)
                at += size
        if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc"):
            both = number(frame[at + 21 : at + 24])
            out["delay"], out["padding"] = both >> 12, both & 0xFFF
        return out
    if frame[36:40] == b"VBRI":
        out["kind"], out["delay"] = "VBRI", number(frame[42:44])
        out["bytes"], out["frames"] = number(frame[46:50]), number(frame[50:54])
        entries, scale, size = (number(frame[k : k + 2]) for k in (54, 56, 58))
        steps = [scale * number(frame[62 + size * k : 62 + size * (k + 1)]) for k in range(entries)]
        out["toc"] = np.cumsum(steps).tolist()
        return out
    return None


def stored_payload(data: bytes, found: dict) -> bytes:
    """The ancillary data of streams written by `encode`."""
    skip = 6 + SIDE
    return b"".join(data[o + skip : o + skip + n // 240 * UNIT] for o, n in zip(found["offsets"], found["lengths"], strict=True))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text's UTF-8 bytes, padded by spaces to a positive multiple of 192, as an MPEG stream.

    Null and empty texts are 192 spaces; texts of any length are one stream; repeated rows
    and rows of one doc_id are kept one to one; other columns, also one called media, are
    left out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for text in batch.column(1).cast(pa.binary()):
                data = text.as_py() or b""
                media.append(encode(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" "), len(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, media binary")


FEATURES = (
    "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "sample_rate int, n_frames long, n_samples long, played_samples long, crc_ok long, crc_bad long, skipped_bytes long, vbr_frames long, frame_offsets array<long>, payload binary"
)


def audio_features(media: DataFrame, with_payload: bool = False) -> DataFrame:
    """Features of media(doc_id, media): exact duration (played_samples / sample_rate), frame seek offsets, checksum results.

    n_samples are those of all frames, played_samples those without the encoder's delay
    and padding.

    n_bytes is the tag's (null without one); the payload columns hold the ancillary data
    of streams written by store_texts. Null or broken media gives zero frames; other
    columns are ignored; rows are kept one to one; an empty table gives an empty result.
    """
    schema = FEATURES.format(id=id_type(media))
    schema = schema if with_payload else schema.replace(", payload binary", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                data = value.as_py() or b""
                found = parse(data)
                payload = stored_payload(data, found)
                rows.append(
                    (
                        int(found["tags"]["n_bytes"]) if found["tags"].get("n_bytes", "").isdigit() else None,
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                        found["hz"], len(found["offsets"]), found["samples"], found["played"], found["crc_ok"], found["crc_bad"], found["skipped"],
                        (found["table"] or {}).get("frames"), found["offsets"], *([payload] if with_payload else []),
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 7, pa.list_(pa.int64()), pa.binary()]
            names = [x.split()[0] for x in schema.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)]], names)

    return media.select("doc_id", "media").mapInArrow(run, schema)
