"""Byte handlers: fixtures, invariants, random mutation."""

import random
import struct
import zlib

import pytest

from metaglean.functions import exif, samples, scrub
from metaglean.functions.core import FLAG_OF_FIELD, Corrupted, MetaError, Options, Unsupported, put16, put32
from metaglean.functions.detect import detect
from metaglean.functions.formats import gif, isobmff, jpeg, pdf, png, raw, svg, tiff, webp
from metaglean.functions.registry import Registry, confidence, supported

MAKE = (samples.jpeg, samples.png, samples.webp, samples.gif, samples.svg, samples.tiff, samples.pdf)
MOVIE = samples.quicktime({"\xa9mak": "Maker", "\xa9xyz": "+12.5-003.25/"}, 77)
STILL = samples.heic(samples.exif_block("Soft"), b"<xmp/>", b"colour")


def test_detection():
    for kind, f in zip(samples.KINDS, MAKE):
        assert detect(f(15, "text")) == kind
    assert [detect(x) for x in (b"", b"\xff\xd8", b"\0\0\0\0\0", b"\xff\xd8\xff\xd9")] == ["unknown"] * 3 + ["jpeg"]
    assert [detect(samples.ftyp(*b) + b"\0" * 4) for b in (("heic",), ("avis",), ("qt  ",), ("MP41",), ("zzzz", "avif"), ("zzzz", "mif1"), ("zzzz", "qt  "))] == ["heic", "avif", "mov", "mp4", "avif", "heic", "unknown"]
    assert detect(b"\n <SVG xmlns='x'>") == "svg" and detect(b"<html xmlns='x'>") == "unknown"


def test_types_by_rule():
    assert jpeg.types(samples.jpeg(15, "x")) == ["EXIF", "XMP", "ICC Profile", "Comment"]
    assert jpeg.types(samples.jpeg(0, "x", samples.segment(0xED, b"Photoshop 3.0\0" + b"8BIM" * 3) + samples.segment(0xEE, b"Adobe\0d"))) == ["IPTC", "Adobe"]
    assert png.types(samples.png(15, "x")) == ["ICC Profile", "EXIF", "Text metadata", "International text"]
    assert webp.types(samples.webp(14, "x")) == ["ICC Profile", "EXIF", "XMP"]
    assert gif.types(samples.gif(13, "x")) == ["Comment", "Application (ICCRGBG1012)", "XMP"]
    assert tiff.types(samples.tiff(15, "x", True)) == ["ImageDescription", "Make", "XMP", "ICC Profile"]
    assert pdf.types(samples.pdf(15, "x")) == ["Document Info", "XMP", "Author/Title", "Timestamps", "JavaScript"]
    assert isobmff.still.types(STILL) == ["EXIF", "XMP", "ICC Profile"]
    assert isobmff.video.types(MOVIE) == ["Timestamps", "Camera Info", "GPS"]


@pytest.mark.parametrize("bits", range(16))
def test_remove_is_clean_and_idempotent(bits):
    for kind, f in zip(samples.KINDS[:6], MAKE):
        d = f(bits, "some text")
        r = scrub.remove(d, Options())
        assert scrub.verify(r.content)["clean"], kind
        assert scrub.remove(r.content, Options()).content == r.content
        assert r.removed_metadata == scrub.types(d)
    for d in (samples.tiff(bits, "some text"), samples.pdf(bits, "some (nested) text"), MOVIE, STILL):
        assert len(scrub.remove(d, Options()).content) == len(d)


def test_content_is_untouched():
    p = scrub.remove(samples.png(15, "x"), Options()).content
    assert samples.chunk(b"IDAT", b"\x78\x9c\x63\0\0\0\2\0\1") in p
    for k, a, n in png.chunks(p):
        assert struct.unpack(">I", p[a + 8 + n : a + 12 + n])[0] == zlib.crc32(p[a + 4 : a + 8 + n]), k
    assert b"\x12\x34\x56\xff\xd9" in scrub.remove(samples.jpeg(15, "x"), Options()).content
    assert b"pixels" in scrub.remove(STILL, Options()).content and b"frames" in scrub.remove(MOVIE, Options()).content
    assert b"Maker" not in scrub.remove(STILL, Options()).content and b"Maker" not in scrub.remove(MOVIE, Options()).content


def test_options():
    assert Options(remove=("GPS",)).resolved() == Options(remove=("GPS",), **{f: True for f in FLAG_OF_FIELD.values()})
    assert Options(keep=("ICC Profile", "Nothing")).resolved().color_profile
    r = scrub.remove(samples.jpeg(15, "x"), Options(color_profile=True))
    assert scrub.types(r.content) == ["ICC Profile"] and "ICC Profile" not in r.removed_metadata
    turned = samples.jpeg(0, "")[:2] + exif.app1(exif.orientation_block(6)) + samples.jpeg(0, "")[2:]
    kept = scrub.remove(turned, Options(orientation=True)).content
    assert jpeg.orientation(kept) == 6 and scrub.read(kept)[0] == {"orientation": 6, "raw": {"ifd0:274": 6}}
    assert "Title" in scrub.types(scrub.remove(samples.svg(15, "x"), Options(title=True)).content)
    w = scrub.remove(samples.webp(15, "x"), Options(color_profile=True)).content
    assert w[12:16] == b"VP8X" and w[20] == 32 and int.from_bytes(w[24:27], "little") == 9


@pytest.mark.parametrize("kind", [0, 1, 2, 5])
def test_inject_then_read(kind):
    o = Options(inject={"artist": " A ", "copyright": "(c) someone", "date_time": "2024-01-02T03:04:05", "software": "   "})
    m = scrub.read(scrub.remove(MAKE[kind](15, "x"), o).content)[0]
    assert (m["artist"], m["copyright"], m["date_time"]) == ("A", "(c) someone", "2024:01:02 03:04:05") and "software" not in m


def test_inject_elsewhere():
    o = Options(inject={"artist": "Writer", "image_description": "a <b>"})
    assert scrub.read(scrub.remove(samples.gif(0, ""), o).content)[0]["image_description"] == "Artist: Writer; Description: a <b>"
    assert b"<title>a &lt;b&gt;</title>" in scrub.remove(samples.svg(0, ""), o).content
    assert scrub.read(scrub.remove(samples.pdf(1, "somebody"), o).content)[0]["artist"].strip() == "Writer"
    m = samples.quicktime({"\xa9des": "a long description"})
    assert scrub.read(scrub.remove(m, o).content)[0]["image_description"] == "a <b>"
    assert gif.inject(samples.gif(0, "") + b"\0", {"artist": "x"}) == samples.gif(0, "") + b"\0"


def test_gps():
    assert exif.degrees([(48, 1), (30, 1), (0, 1)]) == 48.5 and exif.degrees([(1, 0)]) == 0
    d = samples.located(-48.85837, 2.29448)
    for precision, want in (("exact", (-48.85837, 2.29448)), ("city", (-48.85, 2.29)), ("region", (-48.8, 2.2)), ("country", (-48, 2))):
        g = scrub.read(scrub.remove(d, Options(gps_redact=precision)).content)[0]["gps"]
        assert (g["latitude"], g["longitude"]) == pytest.approx(want, abs=1e-9)
    assert "gps" not in scrub.read(scrub.remove(d, Options(gps_redact="remove")).content)[0]
    block = exif.redact_block(exif.gps_block(12.345, -6.789, "exact"), "region")
    out: dict = {}
    exif.read_block(block, out)
    assert out["gps"] == {"latitude": 12.3, "longitude": -6.7}
    assert isobmff.iso6709("+12.5-003.25/") == {"latitude": 12.5, "longitude": -3.25} and isobmff.iso6709("no") is None


def test_altitude_below_sea():
    le = lambda *x: struct.pack("<HHI", *x[:3]) + x[3]
    dms = struct.pack("<6I", 10, 1, 30, 1, 0, 1)
    ifd = struct.pack("<H", 4) + le(2, 5, 3, struct.pack("<I", 80)) + le(4, 5, 3, struct.pack("<I", 104)) + le(5, 1, 1, b"\1\0\0\0") + le(6, 5, 1, struct.pack("<I", 128)) + b"\0" * 4
    d = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + le(34853, 4, 1, struct.pack("<I", 26)) + b"\0" * 4 + ifd
    d = d.ljust(80, b"\0") + dms + dms + struct.pack("<2I", 200, 1)
    out: dict = {}
    exif.read_block(d, out)
    assert out["gps"] == {"latitude": 10.5, "longitude": 10.5, "altitude": -200.0}


def test_exif_fields():
    long = lambda tag, x: struct.pack(">HHI", tag, 4, 1) + put32(x)
    short = lambda tag, x: struct.pack(">HHIHH", tag, 3, 1, x, 0)
    ratio = lambda tag, at: struct.pack(">HHII", tag, 5, 1, at)
    sub = put16(5) + ratio(33434, 200) + ratio(33437, 208) + short(34855, 400) + short(37385, 9) + ratio(37386, 216) + put32(0)
    d = (b"MM\0*" + put32(8) + put16(2) + short(274, 3) + long(34665, 38) + put32(1)).ljust(38, b"\0") + sub
    d = d.ljust(200, b"\0") + struct.pack(">6I", 1, 250, 28, 10, 85, 2)
    out: dict = {}
    exif.read_block(d, out)
    assert out["exif"] == {"exposure_time": "1/250", "f_number": 2.8, "iso": 400, "flash": True, "focal_length": 43}
    assert out["orientation"] == 3 and out["has_thumbnail"]


def test_errors():
    for d in (b"\xff\xd8\xff\xe0\0", b"\xff\xd8\xff\xe0\0\1", b"\xff\xd8\xff\xe0\xff\xff", b"GIF89a\1\0", samples.png(0, "")[:20]):
        with pytest.raises(Corrupted):
            scrub.types(d)
    with pytest.raises(Unsupported):
        scrub.remove(b"\0" * 9, Options())
    locked = samples.pdf(1, "x").replace(b"/Root 1 0 R", b"/Encrypt 9 0 R")
    assert pdf.types(locked) == ["Encrypted"] and scrub.remove(locked, Options()).content == locked
    with pytest.raises(MetaError):
        scrub.remove(locked, Options(pdf_password="x"))
    v = scrub.verify(b"\xff\xd8\xff\xe0\0\1")
    assert v["clean"] and v["warnings"]
    assert not supported("nonsense") and confidence("svg") == "medium" and confidence("x") == "low"


def test_raw():
    inner = samples.jpeg(3, "secret")
    d = b"II*\0\x10\0\0\0CR\2\0" + b"\0" * 4 + struct.pack("<H", 2) + struct.pack("<HHII", 513, 4, 1, 100) + struct.pack("<HHII", 514, 4, 1, len(inner)) + b"\0" * 4
    d = d.ljust(100, b"\0") + inner
    assert detect(d) == "raw" and raw.sub_format(d) == "cr2"
    r = scrub.remove(d, Options())
    assert r.output_format == "jpeg" and r.content == jpeg.remove(inner, Options()) and "EXIF" in r.removed_metadata


def test_thumbnail():
    d = samples.jpeg(0, "")[:-2] + b"\x02\x01\0\4\0\0\0\1\0\0\0\x40" + b"\x02\x02\0\4" + b"\xff\xd9"
    assert scrub.verify(d)["remaining_metadata"] == ["Thumbnail"]


def test_hidden():
    assert scrub.hidden(samples.jpeg(0, "") + b"\0" * 17)[0][0] == "jpeg-trailing-data" and not scrub.hidden(samples.jpeg(0, "") + b"\0" * 16)
    assert scrub.hidden(samples.png(0, "") + b"\0" * 5)[0][3] == 5 and not scrub.hidden(samples.png(0, "") + b"\0" * 4)
    assert scrub.hidden(samples.jpeg(1, "made with steghide"))[0][0] == "jpeg-stego-signature"
    big = samples.png(0, "")[:33] + samples.chunk(b"prVt", b"\0" * 70_000) + samples.png(0, "")[33:]
    assert [w[0] for w in scrub.hidden(big)] == ["png-large-private-chunk"]
    assert [w[0] for w in scrub.hidden(b"\xff\xff\xff\xfftext OpenStego")] == ["stego-tool-signature"]
    scrub.hidden(png.SIGNATURE + b"\xff\xff\xff\xf4aaaa" + b"\0" * 40)  # a huge length must not loop


def test_svg_references_and_instructions():
    d = b'<?xml version="1.0"?><?app x?><svg xmlns:inkscape="http://www.inkscape.org/ns" inkscape:label="a"><!-- c --><rect data-x="1"/></svg>   \n'
    assert svg.remove(d, Options()) == b'<?xml version="1.0"?><svg><rect/></svg>'


def test_registry():
    class Plugin:
        detect = staticmethod(lambda d: d[:2] == b"ZZ" or 1 / 0)
        types = staticmethod(lambda d: ["N"])
        remove = staticmethod(lambda d, o: d[:2])

    r = Registry()
    r.register("Zed", Plugin)
    assert r.names() == ["zed"] and detect(b"ZZtop", r) == "zed" and detect(b"other", r) == "unknown"
    assert scrub.remove(b"ZZtop", Options(), r).content == b"ZZ" and scrub.types(b"ZZtop", r) == ["N"] and scrub.read(b"ZZtop", r)[0] == {}
    assert r.unregister("ZED") and not r.unregister("zed")
    with pytest.raises(TypeError):
        r.register("x", object())


def test_random_mutation_never_raises():
    r = random.Random(11)
    seeds = [f(15, "text") for f in MAKE] + [MOVIE, STILL, samples.heic(b"MM\0*" + b"\0" * 8, version=2), samples.located(1, 2), samples.tiff(15, "t", True)]
    for _ in range(4000):
        d = bytearray(r.choice(seeds))
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(d)) if d else 0
            match r.randint(0, 4):
                case 0 if d:
                    d[at] ^= 1 << r.randint(0, 7)
                case 1:
                    del d[at:]
                case 2:
                    d += bytes(r.randrange(256) for _ in range(r.randint(1, 40)))
                case 3 if d:
                    d[at] = r.choice((0, 255, 1, 127))
                case 4:
                    d[at:at] = r.choice(seeds)[:30]
        d = bytes(d)
        detect(d)
        scrub.verify(d)
        scrub.read(d)
        scrub.hidden(d)
        try:
            scrub.remove(d, Options(gps_redact="city", inject={"artist": "x"}))
        except MetaError:
            pass
