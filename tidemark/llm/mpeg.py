"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

``parse`` reads a stream of MPEG 1, 2 or 2.5 audio, layers I to III: ID3v2, ID3v1 and APE tags, a Xing or Info table (VBRI too) in the first
frame, and the frames, each found from the last one's length. Where no header stands, or at the first frame, the stream is searched for the next place with a valid
header that another consistent one (or the end) follows; the bytes between are counted as skipped. A tag at the end counts only where no frame
reaches over its start that ends with the stream or that a consistent header follows. Checksums are verified in all layers; the protected bits of layer II follow from its bit allocation. A duration is exact: samples and samples a second. Offsets of all frames, in
order, are the seek table.

``store`` writes bytes losslessly as a playable stream: layer III frames of silence (no audio bits) whose main data is the payload, the
last frame at the lowest bitrate that holds the rest, each with its checksum, after an ID3v2 tag with the payload's length and a
Xing frame with counts and a table of contents. ``parse`` gives the payload back.

A null or empty payload is stored as zero bytes of payload; parsing null, empty or foreign bytes gives zero frames and no payload. Streams cut within a frame lose
that frame only. Repeated rows are alike; other columns are kept and those named like an output replaced.
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import slices

# Fixed values of the format: kilobits a second by version and layer, and samples a second by version.
_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLING = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
#: Layer II: bits of a subband's allocation in the four tables of version 1 and the one of version 2.
_WIDTHS = ((4,) * 11 + (3,) * 12 + (2,) * 4, (4,) * 11 + (3,) * 12 + (2,) * 7, (4,) * 2 + (3,) * 6, (4,) * 2 + (3,) * 10, (4,) * 4 + (3,) * 7 + (2,) * 19)
_VERSIONS = {0: "2.5", 2: "2", 3: "1"}


class Header:
    """What the four bytes of a frame header say."""

    __slots__ = ("bound", "channels", "checked", "guarded", "kbps", "layer", "rate", "samples", "side", "size", "version", "widths")

    def __init__(self, version: str, layer: int, kbps: int, rate: int, padding: int, guarded: bool, mode: int, extension: int) -> None:
        self.version, self.layer, self.kbps, self.rate, self.guarded = version, layer, kbps, rate, guarded
        self.channels = 1 if mode == 3 else 2
        first = version == "1"
        if layer == 1:
            self.samples, self.size = 384, (12000 * kbps // rate + padding) * 4
            bound = (extension + 1) * 4 if mode == 1 else 32
            self.checked = (4 * (bound * self.channels + 32 - bound)) // 8
        else:
            self.samples = 1152 if first or layer == 2 else 576
            self.size = self.samples // 8 * 1000 * kbps // rate + padding
            self.checked = None
        self.side, self.widths, self.bound = 0, (), 0
        if layer == 2:
            each = kbps // self.channels
            kind = 4 if not first else 0 if each >= 56 and (rate == 48000 or each <= 80) else 1 if rate != 48000 and each >= 96 else 2 if rate != 32000 and each <= 48 else 3
            self.widths = _WIDTHS[kind]
            self.bound = min((extension + 1) * 4, len(self.widths)) if mode == 1 else len(self.widths)
        if layer == 3:
            self.side = (17 if self.channels == 1 else 32) if first else (9 if self.channels == 1 else 17)
            self.checked = self.side


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The header, or None where the bytes aren't one. Free-format frames, whose length no header gives, aren't read."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer = _VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate, sampling = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or sampling == 3 or four[3] & 3 == 2:
        return None
    return Header(version, layer, _RATES[1 if version == "1" else 2, layer][rate - 1], _SAMPLING[version][sampling], four[2] >> 1 & 1, not four[1] & 1, four[3] >> 6, four[3] >> 4 & 3)


@lru_cache(4096)
def checksum(protected: bytes) -> int:
    """The 16-bit CRC of a frame's protected bytes (polynomial 0x8005, all ones at first)."""
    crc = 0xFFFF
    for byte in protected:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def checksum2(frame: bytes, head: Header) -> int:
    """The CRC of a layer II frame: the header's last half, the allocations, and two selection bits for each channel of a subband with one."""
    after = int.from_bytes(frame[6:70].ljust(64, b"\x00"))
    at = selected = 0
    for band, width in enumerate(head.widths):
        shared = band >= head.bound
        for _ in range(1 if shared else head.channels):
            at += width
            if after >> 512 - at & (1 << width) - 1:
                selected += head.channels if shared else 1
    bits = 16 + at + 2 * selected
    value = int.from_bytes(frame[2:4]) << bits - 16 | after >> 528 - bits
    crc = 0xFFFF
    for k in range(bits - 1, -1, -1):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ (value >> k & 1) else crc << 1) & 0xFFFF
    return crc


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """The tag's length at the start, and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    end = min(len(data), 10 + _syncsafe(data[6:10]))
    at, tags = 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            name = data[at : at + 4].decode()
            if name == "TXXX":
                name, _, text = text.partition("\x00")
            tags[name] = text.rstrip("\x00")
        at += 10 + size
    return end + 10 * bool(data[5] & 0x10), tags


def _tail_tags(data: bytes, start: int) -> tuple[int, dict[str, str]]:
    """Where the tags at the end begin, and their texts."""
    end, tags = len(data), {}
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            text = data[end - 128 + a : end - 128 + b].split(b"\x00")[0].decode("latin-1").strip()
            if text:
                tags[name] = text
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX" and 32 <= int.from_bytes(data[end - 20 : end - 16], "little") <= end - start:
        size, items, flags = struct.unpack("<III", data[end - 20 : end - 8])
        at = max(start, end - size)
        for _ in range(items):
            if at + 8 > end - 32:
                break
            n, stop = int.from_bytes(data[at : at + 4], "little"), data.find(b"\x00", at + 8, end - 32)
            if stop < 0:
                break
            tags[data[at + 8 : stop].decode("latin-1")] = data[stop + 1 : min(stop + 1 + n, end - 32)].decode("utf-8", "replace")
            at = stop + 1 + n
        end = max(start, end - size - (32 if flags & 0x80000000 else 0))
    return end, tags


def _table(frame: bytes, head: Header) -> dict | None:
    """A Xing, Info or VBRI table of the first frame: counts of frames and bytes, and the table of contents."""
    at = 4 + 2 * head.guarded + head.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        out: dict = {"kind": frame[at - 8 : at - 4].decode(), "frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        known = width if width in (1, 2, 3, 4) else 0  # entries of another width aren't read
        body = frame[62 : 62 + entries * known]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [int.from_bytes(body[i : i + known]) * scale for i in range(0, len(body) - known + 1, known)] if known else []}
    return None


def parse(data: bytes | None) -> dict:
    """All that a stream holds; see the module."""
    data = data or b""
    start, tags = _id3v2(data)
    tail, more = _tail_tags(data, start)
    end = tail
    offsets: list[int] = []
    kinds: Counter = Counter()
    body: list[bytes] = []
    skipped = samples = good = bad = total = 0
    table = first = None
    at = start
    while at + 4 <= end:
        head = header(data[at : at + 4])
        if first is None and head is not None and at + head.size != end and not _ends_well(data, at, head):
            head = None  # one header alone is not believed
        if head is not None and at + head.size > end == tail < len(data) and _ends_well(data, at, head) and (first is None or (head.version, head.layer, head.rate) == (first.version, first.layer, first.rate)):
            end, more = len(data), {}
        if head is None or first is not None and (head.version, head.layer, head.rate) != (first.version, first.layer, first.rate) or at + head.size > end:
            to = _resync(data, at + 1, end, first)
            skipped += to - at
            at = to
            continue
        frame = data[at : at + head.size]
        if first is None:
            first, table = head, _table(frame, head)
            if table is not None:
                at += head.size
                continue
        data_at = 4
        if head.guarded:
            data_at = 6
            found = checksum2(frame, head) if head.layer == 2 else checksum(frame[2:4] + frame[6 : 6 + head.checked])
            if found == frame[4] << 8 | frame[5]:
                good += 1
            else:
                bad += 1
        offsets.append(at)
        kinds[head.kbps] += 1
        samples += head.samples
        total += head.size
        if head.layer == 3:
            body.append(frame[data_at + head.side :])
        at += head.size
    skipped += max(0, end - at)
    tags = more | tags
    length = tags.get("payload_bytes", "")
    payload = b"".join(body)[: int(length)] if length.isascii() and length.isdigit() and len(length) < 20 else None
    return {
        "version": first.version if first else None, "layer": first.layer if first else None, "channels": first.channels if first else None, "sample_rate": first.rate if first else None, "samples": samples,
        "frames": len(offsets), "frame_offsets": offsets, "frame_bytes": total, "kbps": dict(kinds), "crc_good": good, "crc_bad": bad, "skipped_bytes": skipped,
        "vbr_kind": table and table["kind"], "vbr_frames": table and table["frames"], "vbr_bytes": table and table["bytes"], "vbr_toc": table["toc"] if table else [], "tags": tags, "payload": payload,
    }


def _ends_well(data: bytes, at: int, head: Header) -> bool:
    """Whether a frame ends with the stream, or a consistent header follows it."""
    to = at + head.size
    after = header(data[to : to + 4])
    return to == len(data) or after is not None and (after.version, after.layer, after.rate) == (head.version, head.layer, head.rate)


def _resync(data: bytes, at: int, end: int, first: Header | None) -> int:
    """The next place of a header that a consistent one or the end follows; else the end."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        head = header(data[at : at + 4])
        if head is not None and at + head.size <= end and (first is None or (head.version, head.layer, head.rate) == (first.version, first.layer, first.rate)):
            after = header(data[at + head.size : at + head.size + 4]) if at + head.size + 4 <= end else head
            if after is not None and (after.version, after.layer, after.rate) == (head.version, head.layer, head.rate):
                return at
        at += 1
    return end


#: Layer III at 48,000 samples a second, mono: a frame has 3 bytes for each kilobit a second; 23 of them are header, checksum and side information.
_RATE, _SIDE, _HEAD = 48000, bytes(17), 23


@lru_cache(32)
def _start(index: int, guarded: bool) -> bytes:
    """Header, checksum and empty side information."""
    head = bytes([0xFF, 0xFA | (not guarded), index << 4 | 1 << 2, 0xC0])
    return head + (checksum(head[2:] + _SIDE).to_bytes(2) if guarded else b"") + _SIDE


def store(payload: bytes) -> bytes:
    """The payload as a stream."""
    rates = _RATES[1, 3]
    most = 3 * rates[-1] - _HEAD
    frames = []
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        index = next(i for i, kbps in enumerate(rates) if 3 * kbps - _HEAD >= len(part)) + 1
        frames.append(_start(index, True) + part + bytes(3 * rates[index - 1] - _HEAD - len(part)))
    offsets, now = [], 0
    for f in frames:
        offsets.append(now)
        now += len(f)
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    body = b"TXXX" + _to_syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _to_syncsafe(len(body)) + body
    size = 3 * 64  # the table's frame: 64 kilobits a second
    toc = bytes(min(255, (size + offsets[i * len(frames) // 100]) * 256 // (size + now)) if frames else 0 for i in range(100))
    table = _start(rates.index(64) + 1, False) + b"Xing" + (7).to_bytes(4) + len(frames).to_bytes(4) + (size + now).to_bytes(4) + toc
    return b"".join([tag, table, bytes(size - len(table)), *frames])


def _to_syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def padded(text: bytes, unit: int = 64) -> bytes:
    """``text`` and zero bytes up to a positive multiple of ``unit``."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def store_texts(df: DataFrame, text: str = "text", out: str = "media", unit: int = 64, keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``: binary, the padded UTF-8 text as a stream."""
    rest = [c for c in df.columns if c != out and (keep_text or c != text)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array([store(padded((x or "").encode(), unit)) for x in part.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, out])

    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, text]))).mapInArrow(run, schema)


#: The column of parsed streams.
INFO = (
    "version string, layer int, channels int, sample_rate int, samples long, frames int, frame_offsets array<long>, frame_bytes long, kbps map<int,int>, crc_good int, crc_bad int, skipped_bytes long, "
    "vbr_kind string, vbr_frames long, vbr_bytes long, vbr_toc array<long>, tags map<string,string>, payload binary"
)


def parse_media(df: DataFrame, media: str = "media", out: str = "audio") -> DataFrame:
    """``df`` with ``out``: a struct of ``INFO``."""
    rest = [c for c in df.columns if c != out]
    info = T.StructType.fromDDL(INFO)
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, info, False)])
    kind = to_arrow_type(info)

    def run(batches):
        for batch in batches:
            for part in slices(batch, media):
                found = [parse(x) for x in part.column(media).to_pylist()]
                made = pa.array([x | {"kbps": list(x["kbps"].items()), "tags": list(x["tags"].items())} for x in found], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, out])

    return df.mapInArrow(run, schema)
