"""DataFrame operators over whole files: one pass of Python over Arrow batches each.

A row holds a whole file.  Files are parsed once an operator and errors become
columns (error_class, error_message, error_offset), never failed tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import scrub
from ..functions.core import Options
from ..functions.detect import detect
from ..functions.formats import svg
from ..functions.registry import Registry
from ..plans.shipping import ship

GPS = "latitude:double,longitude:double,altitude:double,speed:double,direction:double,date_stamp:string"
EXIF = "date_time_original:string,date_time_digitized:string,exposure_time:string,f_number:double,iso:int,focal_length:int,flash:boolean,lens_model:string,lens_manufacturer:string,color_space:int,pixel_width:bigint,pixel_height:bigint,white_balance:int,exposure_mode:int,exposure_program:int"
TEXTS = ("make", "model", "software", "image_description", "artist", "copyright", "date_time")
METADATA = "struct<format:string," + ",".join(f"{t}:string" for t in TEXTS) + f",orientation:int,exif:struct<{EXIF}>,gps:struct<{GPS}>,has_xmp:boolean,has_icc:boolean,has_iptc:boolean,has_thumbnail:boolean,raw:map<string,string>>"
ERROR = "error_class string, error_message string, error_offset bigint"
NO_ERROR = {"error_class": None, "error_message": None, "error_offset": None}
STRUCTURE = "seq int, parent_seq int, depth int, kind string, offset bigint, size bigint, data_offset bigint, data_size bigint, attrs map<string,string>"


def _error(e: Exception) -> dict:
    return {"error_class": type(e).__name__, "error_message": str(e), "error_offset": getattr(e, "offset", None)}


def _mapped(df: DataFrame, content: str, added: str, f: Callable[[bytes], list[dict]], drop_content: bool) -> DataFrame:
    """``df`` with the columns of ``added`` from the rows that ``f`` gives for each file; a name in both is taken from ``f``."""
    ship(df.sparkSession)
    new = StructType.fromDDL(added)
    taken = {x.name.lower() for x in new}
    kept = [c for c in df.columns if c.lower() not in taken and not (drop_content and c == content)]
    schema = StructType([*(df.schema[c] for c in kept), *new])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            files = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                for row in f(files[i].as_py() or b""):
                    rows.append(row)
                    of.append(i)
            at = pa.array(of, pa.int64())
            fresh = [pa.array([r.get(x.name) for r in rows], x.type) for x in arrow]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(kept))), *fresh], [*kept, *arrow.names])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{content}`").alias("__content")).mapInArrow(run, schema)


def structure(df: DataFrame, content: str = "content", registry: Registry | None = None) -> DataFrame:
    """One row for each segment, chunk, block, tag or box; a file that can't be parsed has one row with its error."""

    def f(d: bytes) -> list[dict]:
        fmt = detect(d, registry)
        h = (registry or Registry()).handler(fmt)
        try:
            rows = h.structure(d) if hasattr(h, "structure") else []
        except Exception as e:  # noqa: BLE001
            return [{"format": fmt, **_error(e)}]
        return [{"format": fmt, **r._asdict(), "attrs": list(r.attrs.items()), **NO_ERROR} for r in rows]

    return _mapped(df, content, f"format string, {STRUCTURE}, {ERROR}", f, True)


def metadata_types(df: DataFrame, content: str = "content", registry: Registry | None = None) -> DataFrame:
    """format and types: the kinds of metadata of each file, in the order of their first appearance."""

    def f(d: bytes) -> list[dict]:
        fmt = detect(d, registry)
        try:
            return [{"format": fmt, "types": scrub.types(d, registry, fmt), **NO_ERROR}]
        except Exception as e:  # noqa: BLE001
            return [{"format": fmt, "types": None, **_error(e)}]

    return _mapped(df, content, f"format string, types array<string>, {ERROR}", f, True)


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _metadata(d: bytes, registry: Registry | None) -> tuple[dict, list[str]]:
    m, fmt, warnings = scrub.read(d, registry)
    m = {**m, "format": fmt}
    if "raw" in m:
        m["raw"] = [(k, _text(v)) for k, v in m["raw"].items()]
    return m, warnings


def _types(d: bytes, registry: Registry | None) -> list[str] | None:
    try:
        return scrub.types(d, registry)
    except Exception:  # noqa: BLE001
        return None


def read_metadata(df: DataFrame, content: str = "content", registry: Registry | None = None, types: bool = False) -> DataFrame:
    """metadata (a struct), file_size and warnings; also types, the kinds of metadata, if asked for."""

    def f(d: bytes) -> list[dict]:
        m, warnings = _metadata(d, registry)
        return [{"metadata": m, "file_size": len(d), "warnings": warnings} | ({"types": _types(d, registry)} if types else {})]

    return _mapped(df, content, f"metadata {METADATA}, file_size bigint, warnings array<string>" + (", types array<string>" if types else ""), f, True)


REMOVED = "content binary, format string, original_size bigint, cleaned_size bigint, removed_metadata array<string>, remaining_metadata array<string>, output_format string, warnings array<string>"


CHECKED = {"verify": "clean boolean, confidence string", "read": f"metadata {METADATA}", "types": "types array<string>", "before": f"before {METADATA}"}


def remove_metadata(df: DataFrame, options: Options | None = None, content: str = "content", registry: Registry | None = None, dry_run: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """The cleaned files with what was removed, and what is still listed after it.

    ``also`` checks the cleaned file in the same pass: "verify" adds clean and
    confidence, "read" what metadata can still be read.  Of the file as it was,
    "types" adds the kinds of metadata, "before" the metadata themselves.
    """
    o = options or Options()

    def f(d: bytes) -> list[dict]:
        first = {"types": _types(d, registry)} if "types" in also else {}
        if "before" in also:
            first["before"] = _metadata(d, registry)[0]
        return [first | row for row in cleaned(d)]

    def cleaned(d: bytes) -> list[dict]:
        if dry_run:
            return [{"content": None, "format": detect(d, registry), "original_size": len(d), "cleaned_size": len(d), "removed_metadata": [], **NO_ERROR}]
        try:
            r = scrub.remove(d, o, registry)
        except Exception as e:  # noqa: BLE001
            return [{"format": detect(d, registry), "original_size": len(d), **_error(e)}]
        left, more = _types(r.content, registry), {}
        if "verify" in also:
            v = scrub.verify(r.content, registry)
            more |= {"clean": v["clean"], "confidence": v["confidence"]}
        if "read" in also:
            more["metadata"] = _metadata(r.content, registry)[0]
        return [{**more, "content": r.content, "format": r.format, "original_size": r.original_size, "cleaned_size": len(r.content), "removed_metadata": r.removed_metadata, "remaining_metadata": left, "output_format": r.output_format, "warnings": r.warnings, **NO_ERROR}]

    return _mapped(df, content, ", ".join([REMOVED, *(CHECKED[x] for x in also), ERROR]), f, True)


def verify_clean(df: DataFrame, content: str = "content", registry: Registry | None = None) -> DataFrame:
    """clean, format, remaining_metadata, confidence and warnings."""
    return _mapped(df, content, "clean boolean, format string, remaining_metadata array<string>, confidence string, warnings array<string>", lambda d: [scrub.verify(d, registry)], True)


def all_clean(df: DataFrame, content: str = "content", registry: Registry | None = None) -> bool:
    """Whether no file has metadata left: the gate of a commit hook or a release job."""
    return verify_clean(df, content, registry).where("not clean").isEmpty()


def steganography(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for each sign of a hidden payload."""
    return _mapped(df, content, "code string, message string, offset bigint, size bigint", lambda d: [dict(zip(("code", "message", "offset", "size"), w)) for w in scrub.hidden(d)], True)


def heic_items(df: DataFrame, content: str = "content") -> DataFrame:
    """item_id, kind, offset, length: extents of the items that the item list names as metadata, each once; both lists are in the file."""
    from ..functions.formats import isobmff

    def f(d: bytes) -> list[dict]:
        meta = isobmff._meta(d)[0]
        kinds, found = isobmff.item_kinds(d, meta), {}
        for i, o, n in isobmff.item_extents(d, meta):
            if i in kinds:
                found.setdefault((o, n), {"item_id": i, "kind": kinds[i], "offset": o, "length": n})
        return list(found.values())

    return _mapped(df, content, "item_id bigint, kind string, offset bigint, length bigint", f, True)


def svg_text(content: str = "content") -> Column:
    return F.make_valid_utf8(F.col(content).cast("string"))


def svg_types(content: str = "content") -> Column:
    """Labels of an SVG text as a column expression."""
    text = svg_text(content)
    return F.filter(F.array(*(F.when(text.rlike(p), name) for name, p in svg.LABELS)), lambda x: x.isNotNull())


def svg_remove(content: str = "content", options: Options | None = None) -> Column:
    """The cleaned SVG text as a chain of column expressions."""
    text = svg_text(content)
    for pattern, new in svg.steps((options or Options()).resolved()):
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def inspect_text(metadata: str = "metadata", size: str = "file_size") -> Column:
    """The lines that an inspection prints, without empty fields."""
    from ..functions.textsql import format_size

    m = metadata
    line = lambda label, value: F.concat(F.lit(f"  {label:<10}: "), value)
    shown = lambda c: F.when(F.col(c) != "", F.col(c))
    lines = [line("Format", F.col(f"{m}.format")), line("File size", format_size(F.col(size)))]
    labels = (("Make", "make"), ("Model", "model"), ("Software", "software"), ("DateTime", "date_time"), ("Artist", "artist"), ("Copyright", "copyright"), ("Desc", "image_description"))
    lines += [line(label, shown(f"{m}.{c}")) for label, c in labels]
    number = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    lines.append(line("Orient.", number(f"{m}.orientation")))
    fixed = lambda c, n: F.expr(f"format_number({c}, '0.{'0' * n}')")
    lines += [line("GPS", F.concat(fixed(f"{m}.gps.latitude", 6), F.lit(", "), fixed(f"{m}.gps.longitude", 6))), line("Altitude", F.concat(fixed(f"{m}.gps.altitude", 1), F.lit(" m")))]
    lines += [line("Captured", shown(f"{m}.exif.date_time_original")), line("f/", number(f"{m}.exif.f_number")), line("ISO", number(f"{m}.exif.iso")), line("Focal", F.concat(number(f"{m}.exif.focal_length"), F.lit(" mm")))]
    lines += [line(label, F.when(F.col(f"{m}.has_{c}"), "yes")) for label, c in (("XMP", "xmp"), ("ICC", "icc"), ("IPTC", "iptc"), ("Thumbnail", "thumbnail"))]
    return F.concat_ws("\n", *lines)


def metadata_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, field, before, after: fields whose values differ, nested ones by their full name, in the order of their names."""
    both = before.select(key, F.col("metadata").alias("a")).join(after.select(key, F.col("metadata").alias("b")), key, "full_outer")
    return metadata_changes(both, key, "a", "b")


def metadata_changes(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The same between two metadata columns of one row."""
    names = [*TEXTS, "orientation", "has_xmp", "has_icc", "has_iptc", "has_thumbnail"]
    names += [f"{group}.{x.split(':')[0].strip()}" for group, spec in (("exif", EXIF), ("gps", GPS)) for x in spec.split(",")]
    value = lambda side, n: F.col(f"{side}.{n}").cast("string")
    rows = F.array(*(F.struct(F.lit(n).alias("field"), value(a, n).alias("before"), value(b, n).alias("after")) for n in sorted(names)))
    return df.select(key, F.explode(F.filter(rows, lambda x: ~x.before.eqNullSafe(x.after))).alias("x")).select(key, "x.*")
