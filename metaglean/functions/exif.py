"""TIFF directories: reading, GPS arithmetic, writing."""

from __future__ import annotations

import math
import re
import struct
from datetime import datetime, timezone
from typing import NamedTuple

from .core import Corrupted, latin, put16, put32, u16, u32

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
DECIMALS = {"exact": 10, "city": 2, "region": 1, "country": 0, "remove": -1}
TEXT_TAGS = {"make": 271, "model": 272, "software": 305, "image_description": 270, "artist": 315, "copyright": 33432, "date_time": 306}
_COUNTED = {le: struct.Struct("<HHI4s" if le else ">HHI4s") for le in (True, False)}
INJECT_TAGS = {"image_description": 270, "software": 305, "date_time": 306, "artist": 315, "copyright": 33432}


class Entry(NamedTuple):
    tag: int
    type: int
    count: int
    value: int
    raw: bytes
    at: int

    @property
    def size(self) -> int:
        return SIZES.get(self.type, 1) * self.count


def header(d: bytes, o: int = 0) -> tuple[bool, int] | None:
    """Byte order (true: little-endian) and offset of the first directory."""
    if len(d) < o + 8:
        return None
    for mark, le in ((b"II*\0", True), (b"MM\0*", False)):
        if d[o : o + 4] == mark:
            return le, u32(d, o + 4, le)
    return None


def directory(d: bytes, o: int, le: bool, strict: bool = False) -> tuple[list[Entry], int]:
    """Entries of the directory at ``o`` and the offset of the next one."""
    if o + 2 > len(d):
        if strict:
            raise Corrupted("directory starts past the end", o)
        return [], 0
    n = u16(d, o, le)
    if not strict and n > 512:
        return [], 0
    whole = min(n, (len(d) - o - 2) // 12)
    if strict and whole < n:
        raise Corrupted("directory entry is cut off", o + 2 + 12 * whole)
    read, order, out = _COUNTED[le].unpack_from, "little" if le else "big", []
    for p in range(o + 2, o + 2 + 12 * whole, 12):
        tag, kind, count, raw = read(d, p)
        out.append(Entry(tag, kind, count, int.from_bytes(raw, order), raw, p))
    after = o + 2 + 12 * n
    return out, u32(d, after, le) if after + 4 <= len(d) else 0


def value(d: bytes, e: Entry, le: bool):
    """Text, number(s) or (numerator, denominator) pair(s); None for other types."""
    size = e.size
    at = e.at + 8 if size <= 4 else e.value
    if e.type not in (2, 3, 4, 5, 10) or at + size > len(d) or not e.count:
        return None
    if e.type == 2:
        return latin(d, at, e.count).split("\0", 1)[0].strip()
    kind, step = {3: ("H", 2), 10: ("i", 4)}.get(e.type, ("I", 4))
    raw = struct.unpack_from(f"{'<' if le else '>'}{size // step}{kind}", d, at)
    items = list(zip(raw[::2], raw[1::2])) if e.type in (5, 10) else list(raw)
    return items[0] if e.count == 1 else items


def values(d: bytes, o: int, le: bool) -> dict[int, object]:
    """Values by tag; the last of equal tags counts."""
    return _by_tag(d, directory(d, o, le)[0], le)


def _by_tag(d: bytes, entries: list[Entry], le: bool) -> dict[int, object]:
    return {e.tag: v for e in entries if (v := value(d, e, le)) is not None}


def degrees(dms) -> float:
    """Degrees of three rationals; a zero denominator counts as zero."""
    parts = [n / m if m else 0.0 for n, m in [*dms, (0, 1), (0, 1), (0, 1)][:3]]
    return parts[0] + parts[1] / 60 + parts[2] / 3600


def _ratio(x) -> float | None:
    return x[0] / x[1] if isinstance(x, tuple) and x[1] else None


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def gps(d: bytes, o: int, le: bool) -> dict | None:
    entries, _ = directory(d, o, le)
    t = _by_tag(d, entries, le)
    if not isinstance(t.get(2), list) or not isinstance(t.get(4), list):
        return None
    below = any(e.tag == 5 and e.type == 1 and e.raw[0] == 1 for e in entries)
    lat, lon = degrees(t[2]), degrees(t[4])
    out = {"latitude": -lat if str(t.get(1, "N")).upper() == "S" else lat, "longitude": -lon if str(t.get(3, "E")).upper() == "W" else lon}
    altitude = _ratio(t.get(6))
    if altitude is not None:
        out["altitude"] = -altitude if below else altitude
    for name, tag in (("speed", 13), ("direction", 17)):
        if (x := _ratio(t.get(tag))) is not None:
            out[name] = x
    if t.get(29):
        out["date_stamp"] = t[29]
    return out


def exif(d: bytes, o: int, le: bool) -> dict:
    t, out = values(d, o, le), {}
    for name, tag in (("date_time_original", 36867), ("date_time_digitized", 36868), ("lens_model", 42036), ("lens_manufacturer", 42035), ("pixel_width", 40962), ("pixel_height", 40963)):
        if t.get(tag):
            out[name] = t[tag]
    for name, tag in (("iso", 34855), ("color_space", 41729), ("white_balance", 41987), ("exposure_mode", 41986), ("exposure_program", 34850)):
        if isinstance(t.get(tag), int):
            out[name] = t[tag]
    if _ratio(t.get(33434)) is not None:
        out["exposure_time"] = "{}/{}".format(*t[33434])
    if (x := _ratio(t.get(33437))) is not None:
        out["f_number"] = _half_up(x * 10) / 10
    if (x := _ratio(t.get(37386))) is not None:
        out["focal_length"] = _half_up(x)
    if isinstance(t.get(37385), int):
        out["flash"] = t[37385] & 1 == 1
    return out


def read_block(d: bytes, out: dict) -> None:
    """Adds what an EXIF block (a TIFF structure) says; broken blocks add nothing."""
    try:
        if len(d) < 8:
            return
        le = d[:2] == b"II"
        if u16(d, 2, le) != 42:
            return
        first = u32(d, 4, le)
        entries, following = directory(d, first, le)
        t = {e.tag: v for e in entries if (v := value(d, e, le)) is not None}
        for name, tag in TEXT_TAGS.items():
            if isinstance(t.get(tag), str) and t[tag]:
                out[name] = t[tag]
        if isinstance(t.get(274), int):
            out["orientation"] = t[274]
        if isinstance(t.get(34665), int) and t[34665]:
            out["exif"] = exif(d, t[34665], le)
        if isinstance(t.get(34853), int) and t[34853] and (place := gps(d, t[34853], le)):
            out["gps"] = place
        if following:
            out["has_thumbnail"] = True
        out["raw"] = {f"ifd0:{tag}": v for tag, v in t.items()}
    except Exception:  # noqa: BLE001 - malformed blocks are ignored as a whole
        return


def orientation(d: bytes) -> int | None:
    h = header(d)
    if h is None:
        return None
    found = next((e for e in directory(d, h[1], h[0])[0] if e.tag == 274), None)
    return None if found is None else u16(found.raw, 0, h[0])


def build(fields: list[tuple[int, bytes]]) -> bytes:
    """A big-endian TIFF block of ASCII fields, sorted by tag."""
    body, heap = b"", b""
    start = 8 + 2 + 12 * len(fields) + 4
    for tag, text in sorted(fields):
        raw = text + b"\0"
        body += put16(tag) + put16(2) + put32(len(raw))
        if len(raw) <= 4:
            body += raw.ljust(4, b"\0")
        else:
            body += put32(start + len(heap))
            heap += raw + b"\0" * (len(raw) % 2)
    return b"MM\0*" + put32(8) + put16(len(fields)) + body + put32(0) + heap


def inject_fields(inject: dict[str, str]) -> list[tuple[int, bytes]]:
    given = {k: (v or "").strip() for k, v in inject.items() if k in INJECT_TAGS}
    if given.get("date_time"):
        given["date_time"] = normal_date(given["date_time"])
    return [(INJECT_TAGS[k], v.encode()) for k, v in given.items() if v]


def inject_block(inject: dict[str, str]) -> bytes:
    fields = inject_fields(inject)
    return build(fields) if fields else b""


def normal_date(text: str) -> str:
    """TIFF form of a date where it can be parsed (UTC), else the text itself."""
    if re.fullmatch(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d", text):
        return text
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return text
    if t.tzinfo:
        t = t.astimezone(timezone.utc)
    return t.strftime("%Y:%m:%d %H:%M:%S")


def app1(tiff: bytes) -> bytes:
    return b"\xff\xe1" + put16(len(tiff) + 8) + b"Exif\0\0" + tiff if tiff else b""


def orientation_block(o: int) -> bytes:
    return b"MM\0*" + put32(8) + put16(1) + put16(274) + put16(3) + put32(1) + put16(o) + b"\0\0" + put32(0)


def truncated(x: float, precision: str) -> float:
    d = DECIMALS[precision]
    return math.floor(abs(x) * 10**d) / 10**d


def _coordinate(x: float, precision: str) -> bytes:
    """Three rationals; the sign is in the reference tag.  A denominator of at most 10**7 keeps 180 degrees in 32 bits."""
    d = min(7, DECIMALS[precision])
    n = _half_up(abs(x) * 10**d) if precision == "exact" else math.floor(abs(x) * 10**d)
    return put32(n) + put32(10**d) + (put32(0) + put32(1)) * 2


def gps_block(lat: float, lon: float, precision: str) -> bytes:
    """A TIFF block with nothing but coordinates at the given precision."""
    here = 8 + 2 + 12 + 4
    data = here + 2 + 4 * 12 + 4
    ref = lambda tag, c: put16(tag) + put16(2) + put32(2) + c + b"\0\0\0"
    three = lambda tag, at: put16(tag) + put16(5) + put32(3) + put32(at)
    main = put16(1) + put16(34853) + put16(4) + put32(1) + put32(here) + put32(0)
    sub = put16(4) + ref(1, b"S" if lat < 0 else b"N") + three(2, data) + ref(3, b"W" if lon < 0 else b"E") + three(4, data + 24) + put32(0)
    return b"MM\0*" + put32(8) + main + sub + _coordinate(lat, precision) + _coordinate(lon, precision)


def redact_block(block: bytes, precision: str) -> bytes:
    """An EXIF block with coordinates cut to a precision and no altitude."""
    out = bytearray(block)
    h = header(block)
    if h is None or precision == "exact":
        return bytes(out)
    le = h[0]
    pointer = next((e for e in directory(block, h[1], le)[0] if e.tag == 34853), None)
    if pointer is None:
        return bytes(out)
    for e in directory(block, pointer.value, le)[0]:
        if e.tag in (2, 4) and e.type == 5 and e.count == 3 and e.value + 24 <= len(out):
            d = max(0, DECIMALS[precision])
            n = 0 if precision == "remove" else math.floor(degrees(value(block, e, le)) * 10**d)
            out[e.value : e.value + 24] = b"".join(put32(x, le) for x in (n, 10**d, 0, 1, 0, 1))
        elif e.tag == 6 and e.value + 8 <= len(out):
            out[e.value : e.value + 8] = put32(0, le) + put32(1, le)
        elif e.tag == 5:
            out[e.at + 8] = 0
    return bytes(out)
