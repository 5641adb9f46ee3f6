"""JPEG segments."""

from __future__ import annotations

from .. import exif
from ..core import Corrupted, Options, Row, u16, unique

LABELS = {"exif": "EXIF", "xmp": "XMP", "icc": "ICC Profile", "iptc": "IPTC", "adobe": "Adobe", "comment": "Comment"}
_ADOBE = b"http://ns.adobe.com"
_SIGNED = (
    (0xE1, 10, "exif", (b"Exif\0\0",)),
    (0xE1, 35, "xmp", (_ADOBE + b"/xap/1.0/\0", _ADOBE + b"/xmp/extension/\0")),
    (0xE2, 18, "icc", (b"ICC_PROFILE\0",)),
    (0xED, 20, "iptc", (b"Photoshop",)),
    (0xEE, 9, "adobe", (b"Adobe",)),
)


def role(marker: int, seg: bytes) -> str:
    """What a segment (marker, length and payload) holds."""
    if marker == 0xFE:
        return "comment"
    for m, least, name, marks in _SIGNED:
        if m == marker and len(seg) >= least and seg.startswith(marks, 4):
            return name
    if marker in (0xD9, 0xDA) or 0xD0 <= marker <= 0xD7:
        return "scan"
    return "jfif" if marker == 0xE0 else "unknown_app" if 0xE0 <= marker <= 0xEF else "image"


def segments(d: bytes) -> list[tuple[int, int, int]]:
    """(marker, start, end) after the start marker; the scan takes all up to the last end marker."""
    if d[:3] != b"\xff\xd8\xff" and d[:2] != b"\xff\xd8":
        raise Corrupted("not a JPEG: no start marker")
    out, at, n = [], 2, len(d)
    while at < n - 1:
        if d[at] != 0xFF:
            raise Corrupted("a marker was expected", at)
        while at < n and d[at] == 0xFF:
            at += 1
        if at >= n:
            break
        marker, begin = d[at], at - 1
        at += 1
        if marker == 0xD9:
            out.append((marker, begin, at))
            break
        if marker == 0xDA:
            end = d.rfind(b"\xff\xd9", at + 1)
            out.append((marker, begin, n if end < 0 else end))
            if end >= 0:
                out.append((0xD9, end, end + 2))
            break
        if 0xD0 <= marker <= 0xD7:
            out.append((marker, begin, at))
            continue
        if at + 2 > n:
            raise Corrupted("segment is cut off", at)
        length = u16(d, at)
        if length < 2:
            raise Corrupted("segment length is too small", at)
        if at + length > n:
            raise Corrupted("segment goes past the end", at)
        out.append((marker, begin, at + length))
        at += length
    return out


def structure(d: bytes) -> list[Row]:
    return [Row(i, None, 0, f"FF{m:02X}", a, b - a, min(b, a + (2 if b - a < 4 else 4)), max(0, b - a - 4), {"role": role(m, d[a:b])}) for i, (m, a, b) in enumerate(segments(d))]


def types(d: bytes) -> list[str]:
    return unique([LABELS[r] for m, a, b in segments(d) if (r := role(m, d[a:b])) in LABELS])


def read(d: bytes) -> dict:
    out: dict = {}
    for m, a, b in segments(d):
        r = role(m, d[a:b])
        if r == "exif":
            exif.read_block(d[a + 10 : b], out)
        elif r in ("xmp", "icc", "iptc"):
            out[f"has_{r}"] = True
    return out


def orientation(d: bytes) -> int | None:
    for m, a, b in segments(d):
        if role(m, d[a:b]) == "exif" and (o := exif.orientation(d[a + 10 : b])) is not None:
            return o
    return None


def kept(r: str, o: Options) -> bool:
    return r in ("scan", "jfif", "image") or (r == "icc" and o.color_profile)


def remove(d: bytes, o: Options) -> bytes:
    parts = segments(d)
    turn = orientation(d) if o.orientation else None
    extra = exif.app1(exif.orientation_block(turn)) if turn is not None and turn != 1 else b""
    out = [b"\xff\xd8"]
    for m, a, b in parts:
        if m in (0xDA, 0xD9) and extra:
            out.append(extra)
            extra = b""
        if kept(role(m, d[a:b]), o):
            out.append(d[a:b])
    return b"".join(out)


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    return with_block(d, exif.inject_block(fields))


def with_block(d: bytes, tiff: bytes) -> bytes:
    return d[:2] + exif.app1(tiff) + d[2:] if d[:2] == b"\xff\xd8" else d
