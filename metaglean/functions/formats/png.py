"""PNG chunks."""

from __future__ import annotations

import zlib

from .. import exif
from ..core import Corrupted, Options, Row, latin, put32, u32, unique

SIGNATURE = b"\x89PNG\r\n\x1a\n"
LABELS = {"tEXt": "Text metadata", "iTXt": "International text", "zTXt": "Compressed text", "eXIf": "EXIF", "tIME": "Timestamp", "iCCP": "ICC Profile"}
#: Chunks without which an image does not look the same.
REQUIRED = frozenset("IHDR PLTE IDAT IEND acTL fcTL fdAT bKGD cHRM gAMA hIST pHYs sBIT sPLT sRGB tRNS".split())


def chunks(d: bytes) -> list[tuple[str, int, int]]:
    """(type, start, payload bytes); a cut-off chunk is an error unless image data came before."""
    if d[:8] != SIGNATURE:
        raise Corrupted("not a PNG: no signature")
    out, at = [], 8
    while at + 8 <= len(d):
        n, kind = u32(d, at), latin(d, at + 4, 4)
        if at + 12 + n > len(d):
            if not any(k in ("IHDR", "IDAT") for k, _, _ in out):
                raise Corrupted("chunk is cut off", at)
            break
        out.append((kind, at, n))
        at += 12 + n
        if kind == "IEND":
            break
    return out


def structure(d: bytes) -> list[Row]:
    return [Row(i, None, 0, k, a, n + 12, a + 8, n, {"crc": str(u32(d, a + 8 + n)), "crc_ok": str(u32(d, a + 8 + n) == zlib.crc32(d[a + 4 : a + 8 + n])).lower()}) for i, (k, a, n) in enumerate(chunks(d))]


def types(d: bytes) -> list[str]:
    return unique([LABELS[k] for k, _, _ in chunks(d) if k in LABELS])


def read(d: bytes) -> dict:
    out: dict = {}
    for k, a, n in chunks(d):
        data = d[a + 8 : a + 8 + n]
        if k == "eXIf" and n >= 8:
            exif.read_block(data, out)
        elif k in ("tEXt", "iTXt", "zTXt") and (b"XML:com.adobe.xmp" in data[:40] or b"xpacket" in data[:40]):
            out["has_xmp"] = True
        elif k == "iCCP":
            out["has_icc"] = True
    return out


def chunk(kind: bytes, data: bytes) -> bytes:
    return put32(len(data)) + kind + data + put32(zlib.crc32(kind + data))


def kept(k: str, o: Options) -> bool:
    return k not in LABELS or (k == "iCCP" and o.color_profile)


def remove(d: bytes, o: Options) -> bytes:
    parts = chunks(d)
    turn = next((exif.orientation(d[a + 8 : a + 8 + n]) for k, a, n in parts if k == "eXIf"), None) if o.orientation else None
    out = [SIGNATURE]
    for k, a, n in parts:
        if kept(k, o):
            out.append(chunk(d[a + 4 : a + 8], d[a + 8 : a + 8 + n]))
        if k == "IHDR" and turn is not None and turn != 1:
            out.append(chunk(b"eXIf", exif.orientation_block(turn)))
    return b"".join(out)


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    return with_block(d, exif.inject_block(fields))


def with_block(d: bytes, tiff: bytes) -> bytes:
    return d[:-12] + chunk(b"eXIf", tiff) + d[-12:] if tiff and len(d) >= 20 else d
