"""ISO base media boxes: HEIC, AVIF, MP4 and MOV; everything is blanked in place."""

from __future__ import annotations

import re
from typing import NamedTuple

from .. import exif
from ..core import BoxError, Options, Row, blank, latin, u32, unique


class Box(NamedTuple):
    type: str
    offset: int
    size: int
    data: int

    @property
    def end(self) -> int:
        return self.offset + self.size


CONTAINERS = frozenset("dinf ilst mdia meta minf moov stbl trak udta".split())
_QT = {"GPS": "\xa9xyz \xa9geo loci", "Camera Info": "\xa9mak \xa9mod", "Copyright": "\xa9cpy", "Software": "\xa9swr \xa9enc", "DateTime": "\xa9day", "XMP": "XMP_ uuid", "Metadata": "\xa9aut \xa9des \xa9dir \xa9edl \xa9inf \xa9nam \xa9prd \xa9src \xa9wrt"}
LABEL = {kind: label for label, kinds in _QT.items() for kind in kinds.split()}
FIELD = {"\xa9mak": "make", "\xa9mod": "model", "\xa9swr": "software", "\xa9enc": "software", "\xa9cpy": "copyright", "\xa9day": "date_time", "\xa9nam": "image_description", "\xa9des": "image_description"}
WRITE = {"copyright": b"\xa9cpy", "software": b"\xa9swr", "artist": b"\xa9aut", "image_description": b"\xa9des", "date_time": b"\xa9day"}


def box(d: bytes, at: int, end: int) -> Box | None:
    if at + 8 > end:
        return None
    size, head = u32(d, at), 8
    if size == 1:
        if at + 16 > end:
            return None
        size, head = int.from_bytes(d[at + 8 : at + 16], "big"), 16
    elif size == 0:
        size = len(d) - at
    return Box(latin(d, at + 4, 4), at, size, at + head) if size >= head else None


def boxes(d: bytes, at: int, end: int, slack: int = 0) -> list[Box]:
    out = []
    while at < end and (b := box(d, at, len(d))) and b.end <= end + slack:
        out.append(b)
        at = b.end
    return out


def inside(d: bytes, b: Box) -> list[Box]:
    return boxes(d, b.data + 4 * (b.type == "meta"), min(b.end, len(d)))


def walk(d: bytes) -> list[tuple[Box, int | None, int]]:
    """(box, index of its parent, depth) in order, to depth 10."""
    out: list[tuple[Box, int | None, int]] = []

    def go(at: int, end: int, parent: int | None, depth: int) -> None:
        for b in boxes(d, at, end, 8):
            out.append((b, parent, depth))
            if b.type in CONTAINERS and depth < 10:
                go(b.data + 4 * (b.type == "meta"), min(b.end, len(d)), len(out) - 1, depth + 1)

    go(0, len(d), None, 0)
    return out


def structure(d: bytes) -> list[Row]:
    return [Row(i, p, depth, b.type, b.offset, b.size, b.data, b.end - b.data, {}) for i, (b, p, depth) in enumerate(walk(d))]


class video:
    """MP4 and MOV."""

    structure = staticmethod(structure)

    @staticmethod
    def types(d: bytes) -> list[str]:
        out = []
        for b, _, _ in walk(d):
            if b.type in LABEL:
                out.append(LABEL[b.type])
            elif b.type == "mvhd" and b.data + 12 <= len(d) and d[b.data] == 0 and u32(d, b.data + 4):
                out.append("Timestamps")
        return unique(out)

    @staticmethod
    def _text(d: bytes, b: Box) -> str:
        return latin(d[: b.end], b.data + 16).split("\0", 1)[0].strip() if b.end - b.data > 16 else ""

    @staticmethod
    def read(d: bytes) -> dict:
        out: dict = {}
        for b, _, _ in walk(d):
            if b.type in ("\xa9xyz", "loci"):
                place = iso6709(video._text(d, b))
                if place:
                    out["gps"] = place
            elif b.type in FIELD:
                out[FIELD[b.type]] = video._text(d, b)
            elif b.type == "XMP_":
                out["has_xmp"] = True
        return out

    @staticmethod
    def remove(d: bytes, o: Options) -> bytes:
        out = bytearray(d)
        for b, _, _ in walk(d):
            if b.type in LABEL:
                blank(out, b.data, b.end)
            elif b.type == "mvhd" and b.end - b.data >= 12:
                if d[b.data] == 0:
                    blank(out, b.data + 4, b.data + 12)
                elif d[b.data] == 1 and b.end - b.data >= 24:
                    blank(out, b.data + 4, b.data + 20)
        return bytes(out)

    @staticmethod
    def inject(d: bytes, fields: dict[str, str]) -> bytes:
        out = bytearray(d)
        for key, name in WRITE.items():
            text, at = (fields.get(key) or ""), out.find(name)
            while text.strip() and at >= 0:
                size = u32(out, at - 4) if at >= 4 else 0
                room = size - 24
                if size >= 8 and at - 4 + size <= len(out) and room > 0:
                    raw = text.encode()[:room]
                    out[at + 20 : at + 20 + len(raw)] = raw
                    break
                at = out.find(name, at + 1)
        return bytes(out)


def iso6709(text: str) -> dict | None:
    m = re.search(r"([+-][0-9]+\.?[0-9]*)([+-][0-9]+\.?[0-9]*)", text)
    return {"latitude": float(m[1]), "longitude": float(m[2])} if m else None


def _meta(d: bytes) -> tuple[list[Box], list[Box]]:
    """Children of the top meta box, and of its property container."""
    top = next((b for b in boxes(d, 0, len(d), len(d)) if b.type == "meta"), None)
    children = inside(d, top) if top else []
    iprp = next((b for b in children if b.type == "iprp"), None)
    ipco = next((b for b in inside(d, iprp) if b.type == "ipco"), None) if iprp else None
    return children, inside(d, ipco) if ipco else []


def item_kinds(d: bytes, children: list[Box]) -> dict[int, str]:
    """Item ids of EXIF and XMP items."""
    info = next((b for b in children if b.type == "iinf"), None)
    if info is None or info.data + 8 > len(d):
        return {}
    out = {}
    for b in boxes(d, info.data + (6 if d[info.data] == 0 else 8), min(info.end, len(d))):
        if b.type != "infe" or b.data + 12 > len(d) or d[b.data] < 2:
            continue
        wide = 4 if d[b.data] >= 3 else 2
        item, kind = int.from_bytes(d[b.data + 4 : b.data + 4 + wide], "big"), d[b.data + 6 + wide : b.data + 10 + wide]
        if kind == b"Exif":
            out[item] = "exif"
        elif kind == b"mime" and b"application/rdf+xml" in d[b.data + 10 + wide : min(b.end, b.data + 50 + wide)]:
            out[item] = "xmp"
    return out


def item_extents(d: bytes, children: list[Box]) -> list[tuple[int, int, int]]:
    """(item id, offset, length) of all extents that lie in the file."""
    place = next((b for b in children if b.type == "iloc"), None)
    if place is None or place.data + 8 > len(d):
        return []
    version, a, b = d[place.data], d[place.data + 4], d[place.data + 5]
    at, end, out = place.data + 6, min(place.end, len(d)), []

    def take(n: int) -> int:
        nonlocal at
        if at + n > end:
            raise EOFError
        at += n
        return int.from_bytes(d[at - n : at], "big") if n in (2, 4, 8) else 0

    try:
        for _ in range(take(2 if version < 2 else 4)):
            item = take(2 if version < 2 else 4)
            take(4 if version else 2)
            base = take(b >> 4)
            for _ in range(take(2)):
                take(b & 15 if version else 0)
                offset, length = take(a >> 4), take(a & 15)
                if length and base + offset + length <= len(d):
                    out.append((item, base + offset, length))
    except EOFError:
        pass
    return out


def locations(d: bytes) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of EXIF, XMP and colour data in the known places."""
    children, properties = _meta(d)
    kinds, extents = item_kinds(d, children), item_extents(d, children)
    found = [(b.data, b.end - b.data) for b in properties if b.type == "Exif"]
    found += [(o, n) for i, o, n in extents if kinds.get(i) == "exif"]
    found += [(b.data, b.end - b.data) for b in children if b.type == "Exif"]
    return {"exif": list(dict.fromkeys(found)), "xmp": [(o, n) for i, o, n in extents if kinds.get(i) == "xmp"], "icc": [(b.data, b.end - b.data) for b in properties if b.type in ("colr", "iCCP")]}


class still:
    """HEIC and AVIF."""

    structure = staticmethod(structure)

    @staticmethod
    def types(d: bytes) -> list[str]:
        at, out = locations(d), []
        if at["exif"]:
            out.append("EXIF")
            if any(m in d[o : o + n] for o, n in at["exif"] for m in (b"\x88\x25", b"\x25\x88")):
                out.append("GPS")
        return out + ["XMP"] * bool(at["xmp"]) + ["ICC Profile"] * bool(at["icc"])

    @staticmethod
    def read(d: bytes) -> dict:
        out: dict = {}
        at = locations(d)
        for o, n in at["exif"]:
            block = d[o : o + n]
            if exif.header(block) is None and len(block) > 4:  # an item starts with the offset of its TIFF header
                block = block[4 + u32(block, 0) :]
            exif.read_block(block, out)
        if at["xmp"]:
            out["has_xmp"] = True
        if at["icc"]:
            out["has_icc"] = True
        return out

    @staticmethod
    def remove(d: bytes, o: Options) -> bytes:
        if len(d) < 12:
            raise BoxError("file is too small")
        if d[4:8] != b"ftyp":
            raise BoxError("no ftyp box")
        out = bytearray(d)
        at = locations(d)
        for offset, n in [*at["exif"], *at["xmp"], *([] if o.color_profile else at["icc"])]:
            blank(out, offset, offset + n)
        children, properties = _meta(bytes(out))
        for b in [*children, *properties]:
            if b.type in ("Exif", "xml ") and not any(out[b.data : b.end]):
                out[b.offset + 4 : b.offset + 8] = b"free"
        return bytes(out)

    @staticmethod
    def inject(d: bytes, fields: dict[str, str]) -> bytes:
        return d
