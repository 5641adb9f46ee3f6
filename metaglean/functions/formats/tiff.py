"""TIFF and DNG: the main directory is compacted in place, so all offsets stay."""

from __future__ import annotations

from .. import exif
from ..core import Corrupted, Options, Row, blank, put16, put32, u16, unique

_TAGS = "Artist=315 Copyright=33432 DateTime=306 EXIF=34665 GPS=34853 ICC_Profile=34675 ImageDescription=270 Make=271 Model=272 Orientation=274 Software=305 XMP=700"
NAMES = {int(tag): name.replace("_", " ") for name, tag in (x.split("=") for x in _TAGS.split())}


def main(d: bytes) -> tuple[bool, int, list[exif.Entry], int]:
    h = exif.header(d)
    if h is None:
        raise Corrupted("not a TIFF file")
    return h[0], h[1], *exif.directory(d, h[1], h[0], strict=True)


def structure(d: bytes) -> list[Row]:
    _, _, entries, _ = main(d)
    return [Row(i, None, 0, str(e.tag), e.at, 12, e.at + 8 if e.size <= 4 else e.value, e.size, {"type": str(e.type), "count": str(e.count), "name": NAMES.get(e.tag, f"Tag {e.tag}")}) for i, e in enumerate(entries)]


def types(d: bytes) -> list[str]:
    return unique([NAMES[e.tag] for e in main(d)[2] if e.tag in NAMES])


def read(d: bytes) -> dict:
    out: dict = {}
    exif.read_block(d, out)
    return out


def kept(tag: int, o: Options) -> bool:
    if tag in (274, 34675, 33432):
        return {274: o.orientation, 34675: o.color_profile, 33432: o.copyright}[tag]
    return tag not in NAMES


def _erase_directory(out: bytearray, at: int, le: bool) -> None:
    if at == 0 or at + 2 > len(out) or u16(out, at, le) > 512:
        return
    n = u16(out, at, le)
    for e in exif.directory(bytes(out), at, le)[0]:
        if e.size > 4:
            blank(out, e.value, e.value + e.size)
    blank(out, at, at + 2 + 12 * n + 4)


def remove(d: bytes, o: Options) -> bytes:
    le, at, entries, following = main(d)
    stay = [e for e in entries if kept(e.tag, o)]
    if len(stay) == len(entries):
        return d
    out = bytearray(d)
    for e in entries:
        if kept(e.tag, o):
            continue
        if e.size > 4:
            blank(out, e.value, e.value + e.size)
        elif e.tag in (34665, 34853):
            _erase_directory(out, e.value, le)
    body = put16(len(stay), le) + b"".join(d[e.at : e.at + 12] for e in stay) + put32(following, le)
    whole = 2 + 12 * len(entries) + 4
    out[at : at + whole] = body.ljust(whole, b"\0")[: len(out) - at]
    return bytes(out)


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    """The directory moves to the end of the file with the new fields, so nothing is overwritten."""
    new = exif.inject_fields(fields)
    if not new:
        return d
    le, _, entries, following = main(d)
    tags = {t for t, _ in new}
    rows = [(e.tag, d[e.at : e.at + 12]) for e in entries if e.tag not in tags]
    out = bytearray(d + b"\0" * (len(d) % 2))
    start = len(out)
    heap_at, heap = start + 2 + 12 * (len(rows) + len(new)) + 4, b""
    for tag, text in new:
        raw = text + b"\0"
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else put32(heap_at + len(heap), le)
        if len(raw) > 4:
            heap += raw + b"\0" * (len(raw) % 2)
        rows.append((tag, put16(tag, le) + put16(2, le) + put32(len(raw), le) + where))
    out += put16(len(rows), le) + b"".join(r for _, r in sorted(rows)) + put32(following, le) + heap
    out[4:8] = put32(start, le)
    return bytes(out)
