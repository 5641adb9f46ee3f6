"""SVG text.  The patterns are shared with the column expressions, so they keep to what Java and Python agree on."""

from __future__ import annotations

import re

from ..core import Options, Row, SvgError

PREFIXES = "adobe cc corel dc figma illustrator inkscape photoshop rdf serif sketch sodipodi vectornator xd".split()
_W3, _DC = "www.w3.org/1999/" + "02/22-rdf-syntax-ns", "purl.org/dc/" + "elements"
URIS = sorted([_W3, _DC, *"creativecommons.org/ns ns.adobe.com/Illustrator sodipodi.sourceforge.net www.bohemiancoding.com/sketch/ns www.inkscape.org".split()])
#: Label and pattern, in the order in which labels are listed.
LABELS = [
    ("Metadata element", r"(?i)<metadata"), ("RDF metadata", r"(?i)<rdf:RDF"), ("Dublin Core", r"(?i)<dc:"), ("Creative Commons", r"(?i)<cc:"),
    ("Inkscape metadata", r"(?i)inkscape:"), ("Sodipodi metadata", r"(?i)sodipodi:"), ("Illustrator metadata", r"(?i)illustrator:"), ("XML comments", r"(?s)<!--.*?-->"),
    ("Title", r"(?i)<title"), ("Description", r"(?i)<desc"), ("Data attributes", r"(?i)data-[A-Za-z0-9_-]+\s*="), ("Embedded data URI", r"(?i)\bdata:[^;]+;base64,"),
    ("Embedded script", r"(?i)<script[\s>]"), ("External reference", r"(?i)xlink:href\s*=\s*[\"'](?:[^#]|$)"), ("Foreign object", r"(?i)<foreignObject[\s>]"),
    ("Figma metadata", r"(?i)figma:"), ("Design tool metadata", r"(?i)sketch:|vectornator:"),
]


def _element(name: str) -> list[str]:
    return [rf"(?is)<{name}.*?</{name}>", rf"(?i)<{name}[^>]*/>"]


def steps(o: Options) -> list[tuple[str, str]]:
    """(pattern, replacement) of the removal, in order."""
    drop = [r"(?s)<!--.*?-->", r"(?is)<\?(?!xml[\s?]).*?\?>", *_element("metadata"), r"(?is)<rdf:RDF.*?</rdf:RDF>"]
    drop += [p for name, stay in (("title", o.title), ("desc", o.description)) if not stay for p in _element(name)]
    for p in ("sodipodi", "inkscape"):
        drop += [rf"(?is)<{p}:[A-Za-z0-9_-]+.*?</{p}:[A-Za-z0-9_-]+>", rf"(?i)<{p}:[A-Za-z0-9_-]+[^>]*/>"]
    drop += [rf"(?i)\s+{p}:[A-Za-z0-9_-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')" for p in PREFIXES]
    drop += [rf"(?i)\s+xmlns:[A-Za-z0-9_-]+\s*=\s*[\"'][^\"']*http://{re.escape(u)}[^\"']*[\"']" for u in URIS]
    drop.append(r"(?i)\s+data-[A-Za-z0-9_-]+\s*=\s*[\"'][^\"']*[\"']")
    return [*((p, "") for p in drop), (r"\n\s*\n\s*\n", "\n\n"), (r"(?m)[ \t]+$", "")]


def text_of(d: bytes) -> str:
    text = d.decode("utf-8", "replace").removeprefix("\ufeff")
    start = text.strip()
    if not (start.startswith(("<?xml", "<svg")) and "<svg" in text):
        raise SvgError("not an SVG document")
    return text


def structure(d: bytes) -> list[Row]:
    text = text_of(d)
    at = [(m.start(), m.end(), m[1]) for m in re.finditer(r"<([A-Za-z!?][^\s/>]*)[^>]*>", text)]
    return [Row(i, None, 0, name, a, b - a, a, b - a, {}) for i, (a, b, name) in enumerate(at)]


def types(d: bytes) -> list[str]:
    text = text_of(d)
    return [name for name, p in LABELS if re.search(p, text)]


def read(d: bytes) -> dict:
    text, out = text_of(d), {}
    for field, tag in (("image_description", "title"), ("software", "desc")):
        m = re.search(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", text)
        if m:
            out[field] = m[1].strip()
    if re.search(r"(?i)<metadata|rdf:RDF", text):
        out["has_xmp"] = True
    return out


def remove(d: bytes, o: Options) -> bytes:
    text = text_of(d)
    for pattern, new in steps(o):
        text = re.sub(pattern, new, text)
    return text.strip().encode()


def escape(s: str) -> str:
    for a, b in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        s = s.replace(a, f"&{b};")
    return s


def inject(d: bytes, fields: dict[str, str]) -> bytes:
    text = d.decode("utf-8", "replace")
    names = (("copyright", "rights"), ("artist", "creator"), ("image_description", "description"), ("software", "source"), ("date_time", "date"))
    lines = [f"<dc:{tag}>{escape(fields[k])}</dc:{tag}>" for k, tag in names if fields.get(k)]
    at = text.find(">", text.find("<svg"))
    if not lines or at < 0:
        return d
    spaces = f'xmlns:dc="http://{_DC}/1.1/" xmlns:rdf="http://{_W3}#"'
    block = "".join(lines)
    for tag, more in (("rdf:Description", ""), ("rdf:RDF", " " + spaces), ("metadata", "")):
        block = f"<{tag}{more}>{block}</{tag}>"
    title = f"<title>{escape(fields['image_description'])}</title>" if fields.get("image_description") else ""
    return (text[: at + 1] + "\n  " + block + ("\n  " + title if title else "") + text[at + 1 :]).encode()
