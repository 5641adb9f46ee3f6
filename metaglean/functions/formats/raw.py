"""Camera raw files: DNG is handled as TIFF, the others give their embedded preview."""

from __future__ import annotations

from .. import exif
from ..core import Corrupted, Options, Row, Unsupported, latin, unique
from . import jpeg, tiff


def _tags(d: bytes) -> list[exif.Entry]:
    h = exif.header(d)
    return exif.directory(d, h[1], h[0])[0][:100] if h else []


def make(d: bytes) -> str | None:
    e = next((e for e in _tags(d) if e.tag == 271), None)
    if e is None or e.type != 2:
        return None
    at = e.at + 8 if e.count <= 4 else e.value
    return latin(d, at, min(e.count, 50)) if at + e.count <= len(d) else None


def sub_format(d: bytes) -> str:
    if len(d) < 12:
        return "unknown"
    if d[:4] == b"II*\0" and d[8:10] == b"CR":
        return "cr2"
    if d[4:12] == b"ftypcrx ":
        return "cr3"
    if any(e.tag == 0xC612 for e in _tags(d)):
        return "dng"
    name = make(d) or ""
    return "nef" if "NIKON" in name else "arw" if "SONY" in name else "unknown"


def preview(d: bytes) -> bytes | None:
    """The embedded JPEG: by its tags (a sub-directory wins), else the first large one in the file."""
    h = exif.header(d)
    place: dict[int, int] = {}
    for e in _tags(d):
        place[e.tag] = e.value
    if h and 0 < place.get(330, 0) < len(d):
        place |= {e.tag: e.value for e in exif.directory(d, place[330], h[0])[0][:100] if e.tag in (513, 514)}
    at, n = place.get(513, 0), place.get(514, 0)
    if at and n and at + n <= len(d) and d[at : at + 2] == b"\xff\xd8":
        return d[at : at + n]
    at, end = d.find(b"\xff\xd8\xff", 100), d.rfind(b"\xff\xd9") + 2
    return d[at:end] if at >= 0 and end - at > 10_000 else None


def structure(d: bytes) -> list[Row]:
    return tiff.structure(d)


def types(d: bytes) -> list[str]:
    if sub_format(d) == "dng":
        return tiff.types(d)
    name = (make(d) or "").replace("\0", "").strip()
    return unique([*([f"{name} MakerNotes"] if name else []), *(["EXIF"] if b"Exif\0\0" in d else []), *(["GPS"] if b"\x88\x25" in d else [])])


def read(d: bytes) -> dict:
    out: dict = {}
    at = d.find(b"Exif\0\0")
    exif.read_block(d[at + 6 :] if at >= 0 else d, out)
    return out


def remove(d: bytes, o: Options) -> bytes:
    kind = sub_format(d)
    if kind == "dng":
        return tiff.remove(d, o)
    if kind == "unknown":
        raise Unsupported("unknown raw format")
    found = preview(d)
    if found is None:
        raise Corrupted("no preview in the raw file")
    return jpeg.remove(found, o)


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    return jpeg.inject(d, fields) if d[:2] == b"\xff\xd8" else d
