"""Format detection over bytes; the column form is in operators.detect."""

from __future__ import annotations

from . import exif
from .core import latin
from .formats import raw

BRANDS = {
    "mov": frozenset(("qt  ", "qtvr")),
    "heic": frozenset("heic heim heis heix hevc hevm hevs hevx mif1 msf1".split()),
    "avif": frozenset(("avif", "avis")),
    "mp4": frozenset(["M4A ", "M4P ", "M4V ", "f4p ", "f4v ", *"avc1 dash iso2 iso3 iso4 iso5 iso6 isom mp41 mp42 mp4v".split()]),
}
SIGNATURES = {"jpeg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n", "gif87": b"GIF87a", "gif89": b"GIF89a", "riff": b"RIFF", "webp": b"WEBP", "pdf": b"%PDF-", "ftyp": b"ftyp", "tiff_le": b"II*\0", "tiff_be": b"MM\0*", "exif": b"Exif\0\0"}


def brand(major: str) -> str | None:
    low = major.lower().strip()
    for name in ("heic", "avif"):
        if low in BRANDS[name]:
            return name
    if major in BRANDS["mov"]:
        return "mov"
    return "mp4" if major in BRANDS["mp4"] or low.startswith("mp4") or low == "isom" else None


def compatible(name: str) -> str | None:
    low = name.lower().strip()
    return "avif" if low in BRANDS["avif"] else "heic" if low in BRANDS["heic"] else "mp4" if name in BRANDS["mp4"] else None


def detect(d: bytes, registry=None) -> str:
    """Name of the format, by the first test that fits; plugins come last."""
    if len(d) < 3:
        return "unknown"
    for name in ("jpeg", "png"):
        if d.startswith(SIGNATURES[name]):
            return name
    if d[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        return "webp"
    if d[:5] == b"%PDF-":
        return "pdf"
    if len(d) >= 12 and d[4:8] == b"ftyp":
        found = brand(latin(d, 8, 4))
        if found is None:
            found = next((f for i in range(16, min(len(d), 128) - 3, 4) if (f := compatible(latin(d, i, 4)))), None)
        if found:
            return found
    h = exif.header(d)
    if h is not None:
        tags = exif.directory(d, h[1], h[0])[0][:100]
        if any(e.tag == 0xC612 for e in tags):
            return "dng"
        name = raw.make(d) or ""
        return "raw" if d[8:10] == b"CR" or "NIKON" in name or "SONY" in name else "tiff"
    head = latin(d[:4096]).lower()
    start = head.strip(" \t\r\n\v\f\xa0")
    if start.startswith(("<?xml", "<svg")):
        if "<svg" in head:
            return "svg"
    elif "xmlns" in head and ("http:" + "//www.w3.org/2000/svg" in head or "<svg" in head):
        return "svg"
    return (registry.detect(d) if registry else None) or "unknown"
