"""MPEG audio media columns: texts stored as MPEG-1 Layer III streams, and a parser of MPEG audio.

A payload goes into the main-data area of valid frames whose side information declares no audio bits
(part2_3_length 0), so that the area is ancillary data: a decoder plays silence, and a reader of the
stream gets the bytes back. The lossless unit is 576 bytes a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import batch, keyed, map_arrow, stored, table, utf8

UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (lsf, layer) and index 1 to 14, Hz by version.
BITRATES = {
    (0, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (0, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (0, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (1, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (1, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (1, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Frame:
    """A parsed header: version bits, layer, protection, kbit/s, Hz, channels, length and samples."""

    __slots__ = ("bits", "version", "layer", "protected", "kbps", "rate", "mono", "length", "samples")

    def same_stream(self, other: "Frame") -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


_headers: dict[int, Frame | None] = {}


def header(bits: int) -> Frame | None:
    """The frame that a 32-bit header announces; None if it is none. Free format counts as none."""
    if bits in _headers:
        return _headers[bits]
    version, layer, rate_index, bitrate = bits >> 19 & 3, 4 - (bits >> 17 & 3), bits >> 10 & 3, bits >> 12 & 15
    f = None
    if bits >> 21 == 0x7FF and version != 1 and layer != 4 and rate_index != 3 and 0 < bitrate < 15 and bits & 3 != 2:
        f = Frame()
        lsf, pad = version != 3, bits >> 9 & 1
        f.bits, f.version, f.layer, f.protected, f.mono = bits, version, layer, not bits >> 16 & 1, bits >> 6 & 3 == 3
        f.kbps, f.rate = BITRATES[int(lsf), layer][bitrate - 1], RATES[version][rate_index]
        f.samples = 384 if layer == 1 else 576 if layer == 3 and lsf else 1152
        f.length = (12 * f.kbps * 1000 // f.rate + pad) * 4 if layer == 1 else f.samples // 8 * f.kbps * 1000 // f.rate + pad
    if len(_headers) < 4096:
        _headers[bits] = f
    return f


def side_length(f: Frame) -> int:
    """Bytes of Layer III side information."""
    return (17 if f.mono else 32) if f.version == 3 else (9 if f.mono else 17)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The standard's CRC-16: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for x in data:
        c = c << 8 & 0xFFFF ^ _CRC[c >> 8 ^ x]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16 of the first `bits` bits."""
    whole, left = divmod(bits, 8)
    c = crc16(data[:whole])
    for k in range(left):
        high = c >> 15 ^ data[whole] >> 7 - k & 1
        c = c << 1 & 0xFFFF ^ (0x8005 if high else 0)
    return c


# Fixed values of ISO/IEC 11172-3 and 13818-3, Layer II: (bits of a subband's allocation, subbands) in turn.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "lsf": ((4, 4), (3, 7), (2, 19)),
}


def _allocation(f: Frame) -> str:
    """Which allocation table a Layer II frame uses, by its bitrate a channel and its sampling rate."""
    each = f.kbps if f.mono else f.kbps // 2
    if f.version != 3:
        return "lsf"
    if each <= 48:
        return "d" if f.rate == 32000 else "c"
    return "a" if each <= 80 or f.rate == 48000 else "b"


def guarded(data: bytes, f: Frame) -> tuple[bytes, int]:
    """What the checksum of a protected frame covers: bytes, and how many of their bits.

    The header's last 16 bits; then Layer III's side information, or Layer I's bit allocation, or Layer II's
    bit allocation and scale factor selection, which two bits give for each channel of a subband in use.
    """
    head, body = data[2:4], data[6:]
    if f.layer == 3:
        return head + body[: side_length(f)], 16 + 8 * side_length(f)
    channels, bound = 1 if f.mono else 2, 4 * (f.bits >> 4 & 3) + 4 if f.bits >> 6 & 3 == 1 else 32
    if f.layer == 1:
        bits = sum(4 * (channels if k < bound else 1) for k in range(32))
        return head + body[: bits // 8], 16 + bits
    stream, at, selected = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    widths = [w for w, n in ALLOCATION[_allocation(f)] for _ in range(n)]
    for k, w in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            used = stream >> 512 - at - w & (1 << w) - 1
            selected += 2 * bool(used) * (1 if k < bound else channels)
            at += w
    bits = at + selected
    return head + body[: -(-bits // 8)], 16 + bits


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of a leading ID3v2.3 or 2.4 tag, and its text frames (TXXX under their description)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size, tags, at = 10 + _synchsafe(data[6:10]), {}, 10
    if size > len(data):
        return 0, {}
    while at + 10 <= size and data[at : at + 4].strip(b"\0").isalnum():
        name = data[at : at + 4].decode("latin-1")
        n = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body, at = data[at + 10 : at + 10 + n], at + 10 + n
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text.rstrip("\0")
    return size, tags


def _tail_tag(data: bytes, at: int) -> bool:
    """Whether an ID3v1 tag begins at `at` and is the end of the data."""
    return at + 128 == len(data) and data[at : at + 3] == b"TAG"


def parse(data: bytes) -> dict:
    """What an MPEG audio stream holds.

    offsets, lengths: of every audio frame, in order; samples and rate give the exact duration; resyncs
    and skipped: how often, and over how many bytes, the next frame had to be searched; crc_good and
    crc_bad: of protected frames (a Layer I or II frame too short for what its checksum covers is bad);
    vbr: the leading Xing, Info or VBRI table, whose frame holds no audio; tags: ID3v2 text and ID3v1
    title. A header found by searching counts only if another of the same stream follows it, or the
    data or an ID3v1 tag ends there. Frames go before tags: an ID3v1 tag counts only where no frame
    reaches into the last 128 bytes. Frames of free format are skipped.
    """
    at, tags = _id3v2(data)
    end = len(data)
    out = {"tags": tags, "offsets": [], "lengths": [], "samples": 0, "rate": 0, "resyncs": 0, "skipped": 0, "crc_good": 0, "crc_bad": 0, "vbr": None, "kbps": set()}
    crcs: dict[tuple[bytes, int], int] = {}
    first, lost = None, False
    while at < end:
        if _tail_tag(data, at):
            tags.setdefault("title", data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1"))
            end = at
            break
        f = header(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= end else None
        ok = f is not None and at + f.length <= end and (first is None or f.same_stream(first))
        if ok and (lost or first is None):
            nxt = at + f.length
            g = header(int.from_bytes(data[nxt : nxt + 4], "big")) if nxt + 4 <= end else None
            ok = nxt == end or _tail_tag(data, nxt) or g is not None and g.same_stream(f)
        if not ok:
            if not lost:
                out["resyncs"] += 1
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            if at < end - 128 < nxt and _tail_tag(data, end - 128):
                nxt = end - 128
            out["skipped"] += nxt - at
            at, lost = nxt, True
            continue
        lost = False
        if f.protected:
            body, bits = guarded(data[at : at + f.length], f)
            good = 8 * len(body) >= bits
            if good:
                if (body, bits) not in crcs:
                    if len(crcs) > 4096:
                        crcs.clear()
                    crcs[body, bits] = crc16_bits(body, bits)
                good = crcs[body, bits] == int.from_bytes(data[at + 4 : at + 6], "big")
            out["crc_good" if good else "crc_bad"] += 1
        table_ = _vbr(data[at : at + f.length], f) if first is None and f.layer == 3 else None
        if table_:
            out["vbr"] = table_
        else:
            out["offsets"].append(at)
            out["lengths"].append(f.length)
            out["samples"] += f.samples
            out["kbps"].add(f.kbps)
        first = first or f
        out["rate"] = f.rate
        at += f.length
    return out


def _vbr(frame: bytes, f: Frame) -> dict | None:
    """The variable-bitrate table in a first frame, if there is one.

    toc: of Xing and Info, the 100 bytes of seek points; of VBRI, the offsets in bytes at which its entries end.
    """
    at = 4 + 2 * f.protected + side_length(f)
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": name.decode(), "frames": None, "bytes": None, "toc": None}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"] = frame[at : at + 100]
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        cells = [frame[62 + k * width : 62 + (k + 1) * width] for k in range(n)] if width else []
        steps = [int.from_bytes(x, "big") * scale for x in cells if len(x) == width]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": np.cumsum(steps).tolist(), "frames_per_entry": per}
    return None


# 48 kHz, mono, CRC on: 224 kbit/s frames of 672 bytes carry a unit; 96 kbit/s is the table frame's.
_HEADER = 0xFFFA0000 | 12 << 12 | 1 << 10 | 3 << 6
_TABLE_HEADER = 0xFFFA0000 | 7 << 12 | 1 << 10 | 3 << 6
_SIDE = bytes(17)


def _head(bits: int) -> bytes:
    raw = bits.to_bytes(4, "big")
    return raw + crc16(raw[2:] + _SIDE).to_bytes(2, "big") + _SIDE


_HEAD, _TABLE_HEAD = _head(_HEADER), _head(_TABLE_HEADER)
_LENGTH, _TABLE_LENGTH = header(_HEADER).length, header(_TABLE_HEADER).length


def encode(text: bytes) -> bytes:
    """The stream of a text: an ID3v2.3 tag with its length, a Xing table frame, and a frame for each 576 bytes.

    The text is followed by bytes 255 up to a positive multiple of 576.
    """
    n = max(1, -(-len(text) // UNIT))
    body = np.zeros((n, _LENGTH), np.uint8)
    body[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    units = np.full(n * UNIT, 255, np.uint8)
    units[: len(text)] = np.frombuffer(text, np.uint8)
    body[:, len(_HEAD) : len(_HEAD) + UNIT] = units.reshape(n, UNIT)
    total = _TABLE_LENGTH + n * _LENGTH
    toc = bytes(min(255, (_TABLE_LENGTH + k * n // 100 * _LENGTH) * 256 // total) for k in range(100))
    xing = _TABLE_HEAD + b"Xing" + struct.pack(">III", 7, n, total) + toc
    value = b"\0" + b"payload_length\0" + str(len(text)).encode()
    frame = b"TXXX" + len(value).to_bytes(4, "big") + b"\0\0" + value
    size = len(frame)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frame
    return tag + xing.ljust(_TABLE_LENGTH, b"\0") + body.tobytes()


def decode(data: bytes, parsed: dict) -> bytes:
    """The padded payload of a stream that encode() made, from its parsed frames."""
    if not parsed["offsets"]:
        return b""
    raw = np.frombuffer(data, np.uint8)
    at = np.array(parsed["offsets"])[:, None] + np.arange(len(_HEAD), len(_HEAD) + UNIT)
    return raw[at].tobytes()


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: each whole text as an MPEG audio stream. Null text counts as empty.

    Rows stand alone: null keys, repeated rows and other columns change nothing.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches, schema):
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                yield batch(schema, part.column(0), [encode(t) for t in utf8(part.column(1))])

    return map_arrow(keyed(docs, key, text), run, f"`{key}` {kind}, media binary")


def features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Parses any MPEG audio column and returns exact durations, frame seek offsets, checks and the payload.

    Null or unparsable media have no frames; n_bytes is null where no length tag is found.
    """
    kind = dict(media.dtypes)[key]
    ddl = (
        f"`{key}` {kind}, n_bytes bigint, payload binary, media_bytes bigint, media_sha256 string, n_frames bigint, duration_samples bigint, sample_rate int, "
        "seek_offsets array<bigint>, vbr string, vbr_frames bigint, crc_good bigint, crc_bad bigint, resyncs bigint, skipped bigint"
    )

    def run(batches, schema):
        for b in batches:
            for k in range(0, len(b), 64):
                part, rows = b.slice(k, 64), []
                for raw in part.column(1).to_pylist():
                    raw = raw or b""
                    p = parse(raw)
                    n, vbr = p["tags"].get("payload_length"), p["vbr"] or {}
                    rows.append((int(n) if n and n.isdigit() else None, decode(raw, p) if n else None, len(raw), hashlib.sha256(raw).hexdigest(), len(p["offsets"]), p["samples"], p["rate"], p["offsets"], vbr.get("kind"), vbr.get("frames"), p["crc_good"], p["crc_bad"], p["resyncs"], p["skipped"]))
                if rows:
                    yield batch(schema, part.column(0), *zip(*rows))

    return map_arrow(keyed(media, key, column), run, ddl)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text of documents as MPEG audio, reads the stored table back and digests it."""
    media = stored(media_column(table(spark, sf_dir, "documents")))

    def digest(batches, schema):
        for b in batches:
            c = {n: b.column(n) for n in b.schema.names}
            rows = []
            for r in b.select([x for x in b.schema.names if x not in ("doc_id", "seek_offsets")]).to_pylist():
                p = r["payload"]
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), f"mpeg1-layer3 rate={r['sample_rate']} frames={r['n_frames']} samples={r['duration_samples']} {r['vbr']}={r['vbr_frames']} crc={r['crc_good']}/{r['crc_good'] + r['crc_bad']} resyncs={r['resyncs']} skipped={r['skipped']}"))
            seeks = [zlib.crc32(np.array(x, "<i8").tobytes()) for x in c["seek_offsets"].to_pylist()]
            if rows:
                size, sha, tail, feature = zip(*rows)
                yield batch(schema, c["doc_id"], c["n_bytes"], size, sha, tail, c["media_bytes"], c["media_sha256"], [f"{f} seek_crc32={s}" for f, s in zip(feature, seeks)])

    return map_arrow(features(media), digest, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
