"""WebP (RIFF) chunks."""

from __future__ import annotations

from .. import exif
from ..core import Corrupted, Options, Row, latin, put32, u16, u32, unique

LABELS = {"EXIF": "EXIF", "XMP ": "XMP", "ICCP": "ICC Profile"}
FLAGS = {"ICCP": 32, "ALPH": 16, "EXIF": 8, "XMP ": 4, "ANIM": 2}


def chunks(d: bytes) -> list[tuple[str, int, int]]:
    """(four letters, start, payload bytes) inside the size that the header gives."""
    if len(d) < 12 or d[:4] != b"RIFF" or d[8:12] != b"WEBP":
        raise Corrupted("not a WebP file")
    out, at, end = [], 12, min(len(d), u32(d, 4, True) + 8)
    while at + 8 <= end:
        n = u32(d, at + 4, True)
        if at + 8 + n > len(d):
            raise Corrupted("chunk is cut off", at)
        out.append((latin(d, at, 4), at, n))
        at += 8 + n + n % 2
    return out


def structure(d: bytes) -> list[Row]:
    return [Row(i, None, 0, k, a, 8 + n + n % 2, a + 8, n, {}) for i, (k, a, n) in enumerate(chunks(d))]


def types(d: bytes) -> list[str]:
    return unique([LABELS[k] for k, _, _ in chunks(d) if k in LABELS])


def read(d: bytes) -> dict:
    out: dict = {}
    for k, a, n in chunks(d):
        if k == "EXIF":
            block = d[a + 8 : a + 8 + n]
            exif.read_block(block[6:] if block[:4] == b"Exif" else block, out)
        elif k in LABELS:
            out["has_xmp" if k == "XMP " else "has_icc"] = True
    return out


def _size(parts: list[tuple[str, bytes]]) -> tuple[int, int]:
    for k, x in parts:
        if k == "VP8X" and len(x) >= 10:
            return int.from_bytes(x[4:7], "little") + 1, int.from_bytes(x[7:10], "little") + 1
    for k, x in parts:
        if k == "VP8 " and len(x) >= 10:
            return u16(x, 6, True) & 0x3FFF, u16(x, 8, True) & 0x3FFF
        if k == "VP8L" and len(x) >= 5:
            bits = u32(x, 1, True)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return 0, 0


def extended(parts: list[tuple[str, bytes]]) -> bytes:
    """Payload of an extended header for these chunks."""
    flags = 0
    for k, x in parts:
        flags |= FLAGS.get(k, 0)
        if k == "VP8L" and len(x) >= 5 and x[4] >> 4 & 1:
            flags |= FLAGS["ALPH"]
    w, h = _size(parts)
    return bytes([flags, 0, 0, 0]) + (w - 1 & 0xFFFFFF).to_bytes(3, "little") + (h - 1 & 0xFFFFFF).to_bytes(3, "little")


def build(parts: list[tuple[str, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(k.encode("latin-1") + put32(len(x), True) + x + b"\0" * (len(x) % 2) for k, x in parts)
    return b"RIFF" + put32(len(body), True) + body


def remove(d: bytes, o: Options) -> bytes:
    every = [(k, d[a + 8 : a + 8 + n]) for k, a, n in chunks(d)]
    parts = [(k, x) for k, x in every if k != "VP8X" and (k not in LABELS or (k == "ICCP" and o.color_profile))]
    if any(k in FLAGS for k, _ in parts):
        # The size of an extended image is that of its canvas, so it is taken from the old header.
        parts.insert(0, ("VP8X", extended([*(p for p in every if p[0] == "VP8X"), *parts])))
    return build(parts)


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    return with_block(d, exif.inject_block(fields))


def with_block(d: bytes, tiff: bytes) -> bytes:
    if not tiff or len(d) < 12:
        return d
    out = bytearray(d + b"EXIF" + put32(len(tiff), True) + tiff + b"\0" * (len(tiff) % 2))
    out[4:8] = put32(len(out) - 8, True)
    if len(out) >= 30 and out[12:16] == b"VP8X":
        out[20] |= FLAGS["EXIF"]
    return bytes(out)
