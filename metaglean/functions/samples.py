"""Small media files built by rule, for queries with known answers and for tests.

``bits`` choose the metadata: 1 text, 2 EXIF-like, 4 colour profile or the like, 8 XMP.
"""

from __future__ import annotations

import hashlib

from .core import put16, put32
from .exif import app1, build, gps_block
from .formats.png import SIGNATURE, chunk
from .formats.webp import build as riff, extended

KINDS = "jpeg png webp gif svg tiff pdf".split()
XMP = b"http://ns.adobe.com" + b"/xap/1.0/\0"


#: Characters that one JPEG segment holds with its headers.
LONG = 60_000


def fitting(text: str) -> str:
    """A text that fits a segment, or the digest of all of a longer one."""
    return text if len(text) <= LONG else hashlib.md5(text.encode()).hexdigest()


def exif_block(text: str, camera: str = "Maker") -> bytes:
    return build([(271, camera.encode()), (305, fitting(text).encode())])


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + put16(len(payload) + 2) + payload


def jpeg(bits: int, text: str, extra: bytes = b"") -> bytes:
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    if bits & 2:
        out.append(app1(exif_block(text)))
    if bits & 8:
        out.append(segment(0xE1, XMP + b"<x:xmpmeta/>" + fitting(text).encode()))
    if bits & 4:
        out.append(segment(0xE2, b"ICC_PROFILE\0\1\1" + b"p" * 20))
    if bits & 1:
        out += [segment(0xFE, text[i : i + LONG].encode()) for i in range(0, max(1, len(text)), LONG)]
    out += [extra, segment(0xDB, b"\0" + bytes(range(1, 65))), segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\x34\x56", b"\xff\xd9"]
    return b"".join(out)


def png(bits: int, text: str) -> bytes:
    out = [SIGNATURE, chunk(b"IHDR", put32(1) + put32(1) + b"\x08\x06\0\0\0")]
    if bits & 4:
        out.append(chunk(b"iCCP", b"p\0\0" + b"x" * 10))
    if bits & 2:
        out.append(chunk(b"eXIf", exif_block(text)))
    out.append(chunk(b"IDAT", b"\x78\x9c\x63\0\0\0\2\0\1"))
    if bits & 1:
        out.append(chunk(b"tEXt", b"Comment\0" + text.encode()))
    if bits & 8:
        out.append(chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + text.encode()))
    return b"".join([*out, chunk(b"IEND", b"")])


def webp(bits: int, text: str) -> bytes:
    parts = [("VP8 ", b"\x30\1\0\x9d\x01\x2a" + (10).to_bytes(2, "little") + (20).to_bytes(2, "little"))]
    if bits & 4:
        parts.insert(0, ("ICCP", b"profile-bytes"))
    if bits & 2:
        parts.append(("EXIF", exif_block(text)))
    if bits & 8:
        parts.append(("XMP ", text.encode()))
    return riff([("VP8X", extended(parts)), *parts] if bits & 14 else parts)


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif(bits: int, text: str) -> bytes:
    out = [b"GIF89a\1\0\1\0\x80\0\0", b"\0\0\0\xff\xff\xff", b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0"]
    if bits & 1:
        out.append(b"\x21\xfe" + sub_blocks(text.encode()))
    if bits & 4:
        out.append(b"\x21\xff\x0bICCRGBG1012" + sub_blocks(b"profile"))
    if bits & 8:
        out.append(b"\x21\xff\x0bXMP DataXMP" + sub_blocks(text.encode()))
    return b"".join([*out, b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0", b"\x3b"])


def svg(bits: int, text: str) -> bytes:
    name = "http:" + "//www.w3.org/2000/svg"
    out = [f"<svg xmlns={name!r}>"]
    if bits & 1:
        out.append(f"<title>{text}</title>")
    if bits & 2:
        out.append(f"<desc>{text}</desc>")
    if bits & 8:
        out.append("<metadata>note</metadata>")
    out.append('<rect width="1" data-note="x"/>' if bits & 4 else '<rect width="1"/>')
    return "".join([*out, "</svg>"]).encode()


def tiff(bits: int, text: str, le: bool = False) -> bytes:
    wanted = [(256, 3, put16(1, le)), (270, 2, text.encode() + b"\0"), (271, 2, b"Maker\0"), (700, 1, b"<x:xmpmeta/>"), (34675, 7, b"profile")]
    use = {256: True, 270: bits & 1, 271: bits & 2, 700: bits & 8, 34675: bits & 4}
    rows = [w for w in wanted if use[w[0]]]
    heap_at, heap, body = 8 + 2 + 12 * len(rows) + 4, b"", b""
    for tag, kind, raw in rows:
        n = 1 if kind == 3 else len(raw)
        body += put16(tag, le) + put16(kind, le) + put32(n, le)
        if len(raw) <= 4:
            body += raw.ljust(4, b"\0")
        else:
            body += put32(heap_at + len(heap), le)
            heap += raw + b"\0" * (len(raw) % 2)
    return (b"II*\0" if le else b"MM\0*") + put32(8, le) + put16(len(rows), le) + body + put32(0, le) + heap


def pdf(bits: int, text: str) -> bytes:
    info = "".join([f"/Author ({text}) " if bits & 1 else "", "/CreationDate (D:20240102030405Z) " if bits & 2 else ""])
    out = ["%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"]
    if info:
        out.append(f"4 0 obj\n<< {info}>>\nendobj\n")
    if bits & 8:
        out.append("5 0 obj\n<< /Type /Metadata /Subtype /XML /Length 12 >>\nstream\n<x:xmpmeta/>\nendstream\nendobj\n")
    if bits & 4:
        out.append("6 0 obj\n<< /S /JavaScript /JS (app) >>\nendobj\n")
    out.append("trailer\n<< /Root 1 0 R " + ("/Info 4 0 R " if info else "") + ">>\n%%EOF\n" + " " * 20)
    return "".join(out).encode()


def image(kind: int, bits: int, text: str, broken: bool = False) -> bytes:
    d = (jpeg, png, webp, gif, svg, tiff, pdf)[kind](bits, text)
    if broken and kind < 4:
        return d[: (5, 20, 20, 13)[kind]]
    return d


def box(kind: str, data: bytes, wide: bool = False) -> bytes:
    name = kind.encode("latin-1")
    return put32(1) + name + (len(data) + 16).to_bytes(8, "big") + data if wide else put32(len(data) + 8) + name + data


def ftyp(major: str, *others: str) -> bytes:
    return box("ftyp", major.encode() + put32(0) + "".join(others).encode())


def heic(exif: bytes, xmp: bytes = b"", icc: bytes = b"", version: int = 0) -> bytes:
    """An item list and item locations for EXIF (item 1) and XMP (item 2)."""
    items = [(1, b"Exif", put32(0) + exif)] + ([(2, b"mime", xmp)] if xmp else [])
    infe = b"".join(box("infe", b"\2\0\0\0" + put16(i) + put16(0) + kind + b"\0" + (b"application/rdf+xml\0" if kind == b"mime" else b"")) for i, kind, _ in items)
    iinf = box("iinf", put32(0) + put16(len(items)) + infe)
    iprp = box("iprp", box("ipco", box("colr", icc))) if icc else b""
    head = ftyp("heic", "mif1")

    def iloc(at: int) -> bytes:
        rows = b""
        for i, _, data in items:
            rows += (put32(i) if version == 2 else put16(i)) + (put16(0) if version else b"") + put16(0) + put16(1) + put32(at) + put32(len(data))
            at += len(data)
        return box("iloc", bytes([version, 0, 0, 0, 0x44, 0]) + (put32(len(items)) if version == 2 else put16(len(items))) + rows)

    size = len(head) + len(box("meta", put32(0) + iinf + iloc(0) + iprp)) + 8
    return head + box("meta", put32(0) + iinf + iloc(size) + iprp) + box("mdat", b"".join(x for _, _, x in items) + b"pixels")


def quicktime(texts: dict[str, str], created: int = 0, major: str = "isom") -> bytes:
    """A movie with text atoms (16 bytes of header before the text) and a creation time."""
    udta = b"".join(box(k, b"\0" * 16 + v.encode("latin-1")) for k, v in texts.items())
    return ftyp(major, "isom") + box("moov", box("mvhd", put32(0) + put32(created) + put32(created) + b"\0" * 8) + box("udta", udta)) + box("mdat", b"frames")


def located(lat: float, lon: float, precision: str = "exact", kind: int = 0) -> bytes:
    """A JPEG, PNG or WebP (by ``kind``) with coordinates."""
    block = gps_block(lat, lon, precision)
    if kind == 2:
        parts = [("VP8 ", b"\x30\1\0\x9d\x01\x2a" + (10).to_bytes(2, "little") + (20).to_bytes(2, "little")), ("EXIF", block)]
        return riff([("VP8X", extended(parts)), *parts])
    d = png(0, "") if kind else jpeg(0, "")
    return d[:33] + chunk(b"eXIf", block) + d[33:] if kind else d[:2] + app1(block) + d[2:]


def raw(inner: bytes) -> bytes:
    """A proprietary raw file around a preview JPEG."""
    entry = lambda tag, value: put16(tag, True) + put16(4, True) + put32(1, True) + put32(value, True)
    return (b"II*\0\x10\0\0\0CR\2\0" + b"\0" * 4 + put16(2, True) + entry(513, 100) + entry(514, len(inner)) + b"\0" * 4).ljust(100, b"\0") + inner
