"""PDF: the Info dictionary and XMP streams are blanked in place."""

from __future__ import annotations

import re

from ..core import MetaError, Options, Row, blank, latin

_ENCRYPT = re.compile(rb"/Encrypt(?:\s+\d+){2}\s+R")
_OBJECT = re.compile(rb"(?:^|(?<=[\n\r ]))([0-9]+)\s+([0-9]+)\s+obj\b")
_XMP = re.compile(rb"/Subtype ?/XML|/Type ?/Metadata")
_KEYS = {"artist": ("Author",), "image_description": ("Title",), "software": ("Creator", "Producer"), "date_time": ("CreationDate",)}


def encrypted(d: bytes) -> bool:
    """In the first 8 KB, or in the last trailer."""
    last = d.rfind(b"trailer")
    return bool(_ENCRYPT.search(d[:8192]) or (last >= 0 and _ENCRYPT.search(d[last:])))


def info_range(d: bytes) -> tuple[int, int] | None:
    ref = info_ref(d)
    if ref is None:
        return None
    for m in re.finditer(rb"%d %d obj" % ref, d):
        if m.start() == 0 or d[m.start() - 1] in b"\n\r ":
            end = d.find(b"endobj", m.end())
            if end >= 0:
                return m.start(), end + 6
    return None


def info_ref(d: bytes) -> tuple[int, int] | None:
    last = d.rfind(b"trailer", 0, max(0, len(d) - 20 + 7))
    m = re.search(rb"/Info\s+([0-9]+)\s+([0-9]+)\s+R", d[last : last + 2048]) if last >= 0 else None
    return (int(m[1]), int(m[2])) if m else None


def xmp_ranges(d: bytes) -> list[tuple[int, int]]:
    """Stream bytes of metadata objects, wherever in the object's dictionary the mark stands."""
    out = []
    for m in _OBJECT.finditer(d):
        end = d.find(b"endobj", m.end())
        stream = d.find(b"stream", m.end(), end if end >= 0 else len(d))
        if stream < 0 or not _XMP.search(d, m.end(), stream):
            continue
        start = stream + 6
        start += d[start : start + 1] == b"\r"
        start += d[start : start + 1] == b"\n"
        stop = d.find(b"endstream", start)
        if stop >= 0:
            out.append((start, stop))
    return out


def structure(d: bytes) -> list[Row]:
    parts = [("info", *r) for r in [info_range(d)] if r] + [("xmp", *r) for r in xmp_ranges(d)]
    return [Row(i, None, 0, k, a, b - a, a, b - a, {}) for i, (k, a, b) in enumerate(sorted(parts, key=lambda p: p[1]))]


def types(d: bytes) -> list[str]:
    if encrypted(d):
        return ["Encrypted"]
    out = ["Document Info"] * (info_ref(d) is not None) + ["XMP"] * bool(xmp_ranges(d))
    r = info_range(d)
    tests = [("Author/Title", rb"/(?:Title|Subject|Author|Creator|Producer)\s*\(", d[slice(*r)] if r else b""), ("Timestamps", rb"/(?:CreationDate|ModDate)\s*\(", d[slice(*r)] if r else b"")]
    tests += [("Embedded Files", rb"/EmbeddedFiles\s|/Type\s*/Filespec", d), ("File Attachments", rb"/Subtype\s*/FileAttachment", d), ("JavaScript", rb"/JS\s|/JavaScript\s", d)]
    return out + [name for name, pattern, where in tests if re.search(pattern, where)]


def read(d: bytes) -> dict:
    out: dict = {}
    r = info_range(d)
    if r is None:
        return out
    text = latin(d[slice(*r)])
    for name, keys in _KEYS.items():
        for key in keys:
            m = re.search(rf"/{key}\s*\(([^)]*)\)", text)
            if m and m[1]:
                out[name] = m[1]
                break
    if xmp_ranges(d):
        out["has_xmp"] = True
    return out


def blank_strings(out: bytearray, at: int, end: int) -> None:
    """Literal strings become spaces of the same length; escaped pairs stay."""
    depth = 0
    while at < end:
        c = out[at]
        if depth and c == 0x5C:
            at += 2
            continue
        if c == 0x28:
            depth += 1
            if depth > 1:
                out[at] = 0x20
        elif c == 0x29 and depth:
            depth -= 1
            if depth:
                out[at] = 0x20
        elif depth:
            out[at] = 0x20
        at += 1


def blank_hex(out: bytearray, at: int, end: int) -> None:
    """Hex strings become zeros; dictionary brackets and their keys are no hex strings."""
    for m in re.finditer(rb"(?<!<)<([0-9A-Fa-f\s]*)>", bytes(out[at:end])):
        a, b = at + m.start(1), at + m.end(1)
        out[a:b] = re.sub(rb"[0-9A-Fa-f]", b"0", bytes(out[a:b]))


def remove(d: bytes, o: Options) -> bytes:
    if encrypted(d):
        if o.pdf_password:
            raise MetaError("an encrypted PDF has to be decrypted before its metadata can be removed")
        return d
    out = bytearray(d)
    r = info_range(d)
    if r:
        blank_strings(out, *r)
        blank_hex(out, *r)
    for a, b in xmp_ranges(d):
        blank(out, a, b, 0x20)
    return bytes(out)


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    """Fills blanked strings of the Info dictionary, cut or padded to their length."""
    out = bytearray(d)
    for key, name in (("copyright", b"Author"), ("artist", b"Author"), ("software", b"Producer"), ("image_description", b"Title"), ("date_time", b"CreationDate")):
        text = re.sub(r"[()\\]", "", fields.get(key) or "")
        m = re.search(rb"/" + name + rb"\s*\(( +)\)", bytes(out))
        if text.strip() and m:
            n = len(m[1])
            out[m.start(1) : m.end(1)] = text.encode("latin-1", "replace")[:n].ljust(n)
    return bytes(out)
