"""Column expressions over paths, sizes, dates and data URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .bytesql import quote
from .registry import CONFIDENCE, DATA_URL_MIMES, EXTENSIONS, HANDLERS, MIME


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** any, **/ whole folders, * and ? within a name."""
    out = ["(?i)^"]
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern):
        out.append({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", piece))
    return "".join(out) + "$"


def matches_glob(name: Column, pattern: str) -> Column:
    return name.rlike(glob_regex(pattern))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def known_extension(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def selected(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Extension, exclude and include rules, in that order, on the base name."""
    name, ok = base_name(path), known_extension(path)
    for p in exclude:
        ok &= ~matches_glob(name, p)
    if include:
        wanted = F.lit(False)
        for p in include:
            wanted |= matches_glob(name, p)
        ok &= wanted
    return ok


def output_path(path: Column, suffix: str = "-clean", folder: str | None = None, in_place: bool = False, output_format: Column | None = None) -> Column:
    if in_place:
        return path
    old = F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)
    new = old
    if output_format is not None:
        named = F.concat(F.lit("."), F.when(output_format == "jpeg", "jpg").otherwise(output_format))
        new = F.when(output_format.isNull() | (output_format == "unknown"), old).otherwise(named)
    stem = F.substring(base_name(path), F.lit(1), F.length(base_name(path)) - F.length(old))
    where = F.lit(folder.rstrip("/") + "/") if folder is not None else F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(where, stem, F.lit(suffix), new)


def bundle_name(name: Column) -> Column:
    """_clean before the last dot, or at the end."""
    return F.when(name.contains("."), F.regexp_replace(name, r"^(.*)(\.[^.]*)$", "$1_clean$2")).otherwise(F.concat(name, F.lit("_clean")))


def _size(n: int | None) -> str | None:
    if n is None:
        return None
    for least, unit in ((1_000_000, "MB"), (1_000, "KB")):
        if n >= least:
            return f"{n / least:.1f} {unit}"
    return f"{n} B"


#: Decimal units with one digit.  Java rounds ties on the decimal text, so Python formats the number.
format_size = F.udf(_size, StringType(), useArrow=True)


def normalize_datetime(text: Column) -> Column:
    t = F.try_to_timestamp(text)
    return F.when(text.rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"), text).otherwise(F.coalesce(F.date_format(t, "yyyy:MM:dd HH:mm:ss"), text))


def mime_type(fmt: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))[fmt]


def confidence(fmt: Column) -> Column:
    return F.when(fmt.isin(CONFIDENCE["high"]), "high").when(fmt.isin(CONFIDENCE["medium"]), "medium").otherwise("low")


def is_supported(fmt: Column) -> Column:
    return fmt.isin(list(HANDLERS))


def escape_xml(text: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def iso6709(text: Column) -> Column:
    """latitude and longitude of the first two signed decimals."""
    pattern = r"([+-][0-9]+\.?[0-9]*)([+-][0-9]+\.?[0-9]*)"
    one = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return F.when(text.rlike(pattern), F.struct(one(1).alias("latitude"), one(2).alias("longitude")))


def parse_data_url(column: str) -> Column:
    """struct<content: binary, error: string> of a column of data URLs."""
    u, allowed = f"`{column}`", ", ".join(quote(m) for m in DATA_URL_MIMES)
    head = f"substring_index(substr({u}, 6), ',', 1)"
    content = f"try_to_binary(substr({u}, instr({u}, ',') + 1), 'base64')"
    error = f"""CASE WHEN {u} IS NULL OR NOT startswith({u}, 'data:') THEN 'not a data URL' WHEN NOT contains({u}, ',') THEN 'no comma'
        WHEN NOT endswith({head}, ';base64') THEN 'not base64'
        WHEN {head} <> ';base64' AND regexp_replace({head}, ';base64$', '') NOT IN ({allowed}) THEN 'unknown type'
        WHEN {content} IS NULL THEN 'broken base64' END"""
    return F.expr(f"transform(array({error}), e -> struct(CASE WHEN e IS NULL THEN {content} END AS content, e AS error))[0]")


def redacted(x: Column, precision: str) -> Column:
    """A coordinate's size cut (never rounded) to the decimals of a precision."""
    from .exif import DECIMALS

    d = F.lit(float(10 ** max(0, DECIMALS[precision])))
    return F.floor(F.abs(x) * d).cast("double") / d


def dms_degrees(d: Column, m: Column, s: Column) -> Column:
    return d + m / 60 + s / 3600
