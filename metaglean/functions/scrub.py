"""Whole-file operations over bytes: types, read, remove, verify, hidden data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import exif
from .core import Options, Unsupported
from .detect import detect
from .formats import jpeg, png, webp
from .registry import Registry, confidence

PRESERVED = (("color_profile", "ICC Profile"), ("copyright", "Copyright"), ("orientation", "Orientation"), ("title", "Title"), ("description", "Description"))


@dataclass
class Removed:
    content: bytes
    format: str
    original_size: int
    removed_metadata: list[str]
    output_format: str | None = None
    warnings: list[str] = field(default_factory=list)


def types(d: bytes, registry: Registry | None = None, fmt: str | None = None) -> list[str]:
    h = (registry or Registry()).handler(fmt or detect(d, registry))
    return list(dict.fromkeys(h.types(d))) if h else []


def read(d: bytes, registry: Registry | None = None) -> tuple[dict, str, list[str]]:
    fmt = detect(d, registry)
    h = (registry or Registry()).handler(fmt)
    try:
        return (h.read(d) if h and hasattr(h, "read") else {}), fmt, []
    except Exception as e:  # noqa: BLE001
        return {}, fmt, [str(e)]


def remove(d: bytes, options: Options, registry: Registry | None = None) -> Removed:
    fmt = detect(d, registry)
    h = (registry or Registry()).handler(fmt)
    if h is None:
        raise Unsupported(f"unsupported format: {fmt}")
    o, warnings = options.resolved(), []
    place = None
    if o.gps_redact and o.gps_redact != "remove" and fmt in ("jpeg", "png", "webp", "tiff", "dng"):
        try:
            place = h.read(d).get("gps")
        except Exception as e:  # noqa: BLE001
            warnings.append(f"coordinates could not be read: {e}")
    listed = types(d, registry, fmt)
    out = h.remove(d, o)
    if place and fmt in ("jpeg", "png", "webp"):
        block = exif.gps_block(place["latitude"], place["longitude"], o.gps_redact)
        out = {"jpeg": jpeg, "png": png, "webp": webp}[fmt].with_block(out, block)
    if o.inject and hasattr(h, "inject"):
        try:
            out = h.inject(out, o.inject)
        except Exception as e:  # noqa: BLE001
            warnings.append(f"injection failed: {e}")
    for flag, label in PRESERVED:
        if getattr(o, flag) and label in listed:
            listed.remove(label)
    after = detect(out, registry) if fmt == "raw" else None
    return Removed(out, fmt, len(d), listed, after if after not in ("raw", "unknown") else None, warnings)


_THUMBNAIL = re.compile(rb"\x02\x01\x00\x04\x00\x00\x00\x01(....)|\x01\x02\x04\x00\x01\x00\x00\x00(....)", re.S)


def has_thumbnail(d: bytes) -> bool:
    """A thumbnail offset entry that is not zero, with a length entry within 120 bytes of it."""
    at = 0
    while m := _THUMBNAIL.search(d, at):
        at = m.start() + 1
        number = int.from_bytes(m[1], "big", signed=True) if m[1] is not None else int.from_bytes(m[2], "little", signed=True)
        if number > 0 and b"\x02\x02" in d[max(0, m.start() - 120) : m.start() + 121]:
            return True
    return False


def verify(d: bytes, registry: Registry | None = None) -> dict:
    fmt, left, warnings = detect(d, registry), [], []
    try:
        left = types(d, registry, fmt)
    except Exception as e:  # noqa: BLE001
        warnings.append(f"could not be verified: {e}")
    if fmt in ("jpeg", "tiff", "heic", "avif") and has_thumbnail(d):
        left.append("Thumbnail")
        warnings.append("an embedded thumbnail may show the original picture")
    return {"clean": not left, "format": fmt, "remaining_metadata": left, "confidence": confidence(fmt), "warnings": warnings}


_TOOLS = re.compile(r"(?i)openstego|steghide|jphide|invisible\s*secrets")


def hidden(d: bytes) -> list[tuple[str, str, int | None, int | None]]:
    """(code, message, offset, size) of signs of hidden payloads."""
    out: list[tuple[str, str, int | None, int | None]] = []
    fmt = detect(d)
    if fmt == "jpeg":
        end = d.rfind(b"\xff\xd9", 2)
        if end >= 0 and len(d) - end - 2 > 16:
            out.append(("jpeg-trailing-data", f"{len(d) - end - 2} bytes follow the end of the image", end + 2, len(d) - end - 2))
        at = 2
        while at + 3 < len(d) and d[at] == 0xFF and d[at + 1] != 0xDA:
            marker = d[at + 1]
            if marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
                at += 2
                continue
            n = int.from_bytes(d[at + 2 : at + 4], "big")
            if marker == 0xFE and n > 2 and _TOOLS.search(d[at + 4 : at + 2 + n].decode("utf-8", "replace")):
                out.append(("jpeg-stego-signature", "a comment names a hiding tool", at, n + 2))
            at += 2 + n
    elif fmt == "png":
        at = d.find(b"IEND", 12)
        if at >= 0:
            end = at + 8 + int.from_bytes(d[at - 4 : at], "big")
            if len(d) - end > 4:
                out.append(("png-trailing-data", f"{len(d) - end} bytes follow the last chunk", end, len(d) - end))
        at = 8
        while at + 8 < len(d):  # lengths are unsigned, so this always moves on
            n, kind = int.from_bytes(d[at : at + 4], "big"), d[at + 4 : at + 8]
            if kind[0] >= 0x61 and n > 65536:
                out.append(("png-large-private-chunk", f"private chunk of {n} bytes", at, n + 12))
            at += 12 + n
            if kind == b"IEND":
                break
    tail = d[-65536:]
    for tool in (b"openstego", b"steghide"):
        if tool in tail.lower():
            out.append(("stego-tool-signature", f"the tail of the file names {tool.decode()}", None, None))
            break
    return out
