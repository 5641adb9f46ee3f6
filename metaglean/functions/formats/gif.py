"""GIF blocks."""

from __future__ import annotations

from ..core import Corrupted, Options, Row, latin, unique


def _sub_blocks(d: bytes, at: int) -> int:
    """The end of a run of sub-blocks; the end of the data may stand for the last one."""
    while at < len(d):
        n = d[at]
        at += 1
        if not n:
            return at
        if at + n > len(d):
            raise Corrupted("sub-block is cut off", at)
        at += n
    return at


def blocks(d: bytes) -> list[tuple[str, int, int, dict[str, str]]]:
    """(kind, start, end, attributes) of all blocks up to the trailer."""
    if d[:6] not in (b"GIF87a", b"GIF89a"):
        raise Corrupted("not a GIF file")
    if len(d) < 13:
        raise Corrupted("screen descriptor is cut off", 6)
    out, at = [("header", 0, 6, {}), ("screen", 6, 13, {})], 13
    if d[10] & 0x80:
        n = 3 << (d[10] & 7) + 1
        if at + n > len(d):
            raise Corrupted("colour table is cut off", at)
        out.append(("colours", at, at + n, {}))
        at += n
    while at < len(d):
        begin, mark = at, d[at]
        if mark == 0x3B:
            out.append(("trailer", at, at + 1, {}))
            break
        if mark == 0x21 and at + 1 < len(d):
            label, at = d[at + 1], at + 2
            attrs = {"label": str(label)}
            if label == 0xFF and at < len(d) and d[at] == 11 and at + 12 <= len(d):
                attrs["app"] = latin(d, at + 1, 11)
            at = _sub_blocks(d, at)
            out.append(("extension", begin, at, attrs))
        elif mark == 0x2C:
            if at + 10 > len(d):
                raise Corrupted("image descriptor is cut off", at)
            n = 3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0
            at = _sub_blocks(d, min(len(d), at + 10 + n + 1))
            out.append(("image", begin, at, {}))
        else:
            at += 1
    return out


def role(kind: str, attrs: dict[str, str]) -> str:
    if kind != "extension":
        return "image"
    if attrs["label"] == "254":
        return "comment"
    if attrs["label"] != "255":
        return "image"
    app = attrs.get("app", "")
    return "loop" if app.startswith("NETSCAPE") else "xmp" if "XMP" in app else "app"


def structure(d: bytes) -> list[Row]:
    return [Row(i, None, 0, k, a, b - a, a + (2 if k == "extension" else 0), b - a - (2 if k == "extension" else 0), x | {"role": role(k, x)}) for i, (k, a, b, x) in enumerate(blocks(d))]


def types(d: bytes) -> list[str]:
    out = []
    for k, _, _, x in blocks(d):
        r = role(k, x)
        if r in ("comment", "xmp"):
            out.append("Comment" if r == "comment" else "XMP")
        elif r == "app":
            out.append(f"Application ({x.get('app', 'unknown')})")
    return unique(out)


def comment(d: bytes, a: int, b: int) -> str:
    out, at = [], a + 2
    while at < b and d[at] and at + 1 + d[at] <= b:
        out.append(latin(d, at + 1, d[at]))
        at += 1 + d[at]
    return "".join(out)


def read(d: bytes) -> dict:
    out: dict = {}
    found = []
    for k, a, b, x in blocks(d):
        r = role(k, x)
        if r == "xmp":
            out["has_xmp"] = True
        elif r == "comment" and (text := comment(d, a, b)):
            found.append(text)
    if found:
        out |= {"image_description": found[0], "raw": {"comments": found}}
    return out


def remove(d: bytes, o: Options) -> bytes:
    return b"".join(d[a:b] for k, a, b, x in blocks(d) if role(k, x) in ("image", "loop"))


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    names = (("copyright", "Copyright"), ("artist", "Artist"), ("software", "Software"), ("image_description", "Description"), ("date_time", "DateTime"))
    text = "; ".join(f"{label}: {fields[k]}" for k, label in names if fields.get(k)).encode()
    if not text or d[-1:] != b"\x3b":
        return d
    runs = [text[i : i + 255] for i in range(0, len(text), 255)]
    return d[:-1] + b"\x21\xfe" + b"".join(bytes([len(r)]) + r for r in runs) + b"\0\x3b"
