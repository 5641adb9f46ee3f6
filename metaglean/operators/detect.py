"""Format detection as one column expression, so it runs inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytesql import big, hexed, latin1, let, number, part, quote
from ..functions.detect import BRANDS, SIGNATURES


def _in(expr: str, names) -> str:
    return f"{expr} IN ({', '.join(quote(n) for n in sorted(names))})"


def brand_sql(c: str) -> str:
    """Format by the major brand, else by the first compatible brand that is known; null if none is."""
    major = latin1(part(c, 8, 4))
    first = f"CASE WHEN {_in('lower(trim(b))', BRANDS['heic'])} THEN 'heic' WHEN {_in('lower(trim(b))', BRANDS['avif'])} THEN 'avif' WHEN {_in('b', BRANDS['mov'])} THEN 'mov' WHEN {_in('b', BRANDS['mp4'])} OR lower(trim(b)) LIKE 'mp4%' OR lower(trim(b)) = 'isom' THEN 'mp4' END"
    one = f"CASE WHEN {_in('lower(trim(b))', BRANDS['avif'])} THEN 'avif' WHEN {_in('lower(trim(b))', BRANDS['heic'])} THEN 'heic' WHEN {_in('b', BRANDS['mp4'])} THEN 'mp4' END"
    others = f"get(filter(transform(sequence(16, 124, 4), i -> CASE WHEN i + 4 <= length({c}) THEN {let(latin1(part(c, 'i', 4)), 'b', one)} END), x -> x IS NOT NULL), 0)"
    return f"coalesce({let(major, 'b', first)}, {others})"


def tag_sql(c: str, found: str) -> str:
    """True if ``found`` (over p, the entry's offset, and le) holds for one of the first 100 entries."""
    le = f"({part(c, 0, 1)} = X'49')"
    start = number(c, 4, 4, le)
    n = f"coalesce({number(c, 'o', 2, le)}, 0)"
    entries = f"CASE WHEN n > 0 THEN exists(sequence(0, cast(least(n, 100) AS int) - 1), i -> o + 14 + 12 * i <= length({c}) AND {let('o + 2 + 12 * i', 'p', found)}) ELSE false END"
    return let(start, "o", f"coalesce({let(n, 'n', entries)}, false)")


def detect_sql(c: str) -> str:
    le = f"({part(c, 0, 1)} = X'49')"
    tag = number(c, "p", 2, le)
    size = number(c, "p + 4", 4, le)
    text = latin1(part(c, f"cast(CASE WHEN {size} <= 4 THEN p + 8 ELSE {number(c, 'p + 8', 4, le)} END AS int)", f"cast(least({size}, 50) AS int)"))
    place = f"CASE WHEN {size} <= 4 THEN p + 8 ELSE {number(c, 'p + 8', 4, le)} END"
    maker = f"CASE WHEN {tag} = 271 AND {number(c, 'p + 2', 2, le)} = 2 AND {place} + {size} <= length({c}) THEN {text} LIKE '%NIKON%' OR {text} LIKE '%SONY%' ELSE false END"
    head = f"lower({latin1(part(c, 0, 4096))})"
    svg = "CASE WHEN ltrim(' \t\r\n', h) LIKE '<?xml%' OR ltrim(' \t\r\n', h) LIKE '<svg%' THEN contains(h, '<svg') ELSE contains(h, 'xmlns') AND (contains(h, concat('http:', '//www.w3.org/2000/svg')) OR contains(h, '<svg')) END".replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n")
    svg = svg.replace("ltrim(' \\t\\r\\n', h)", "trim(LEADING ' \\t\\r\\n' FROM h)")
    s = SIGNATURES
    return f"""CASE WHEN {c} IS NULL OR length({c}) < 3 THEN 'unknown' WHEN startswith({c}, {hexed(s['jpeg'])}) THEN 'jpeg' WHEN startswith({c}, {hexed(s['png'])}) THEN 'png'
        WHEN startswith({c}, {hexed(s['gif87'])}) OR startswith({c}, {hexed(s['gif89'])}) THEN 'gif'
        WHEN startswith({c}, {hexed(s['riff'])}) AND {part(c, 8, 4)} = {hexed(s['webp'])} THEN 'webp' WHEN startswith({c}, {hexed(s['pdf'])}) THEN 'pdf'
        WHEN length({c}) >= 12 AND {part(c, 4, 4)} = {hexed(s['ftyp'])} AND {brand_sql(c)} IS NOT NULL THEN {brand_sql(c)}
        WHEN length({c}) >= 8 AND (startswith({c}, {hexed(s['tiff_le'])}) OR startswith({c}, {hexed(s['tiff_be'])})) THEN
            CASE WHEN {tag_sql(c, f'{tag} = 50706')} THEN 'dng' WHEN {part(c, 8, 2)} = X'4352' OR {tag_sql(c, maker)} THEN 'raw' ELSE 'tiff' END
        WHEN {let(head, 'h', svg)} THEN 'svg' ELSE 'unknown' END"""


def detect_format(content: str = "content") -> Column:
    return F.expr(detect_sql(f"`{content}`"))


def with_format(df: DataFrame, content: str = "content", into: str = "format") -> DataFrame:
    return df.withColumn(into, detect_format(content))


def raw_sub_format(content: str = "content") -> Column:
    """cr2, cr3, dng, nef, arw or unknown."""
    c = f"`{content}`"
    le = f"({part(c, 0, 1)} = X'49')"
    tag, size = number(c, "p", 2, le), number(c, "p + 4", 4, le)
    at = f"cast(CASE WHEN {size} <= 4 THEN p + 8 ELSE {number(c, 'p + 8', 4, le)} END AS int)"
    named = lambda w: tag_sql(c, f"CASE WHEN {tag} = 271 AND {at} + {size} <= length({c}) THEN {latin1(part(c, at, f'cast(least({size}, 50) AS int)'))} LIKE '%{w}%' ELSE false END")
    tiff = f"(startswith({c}, X'49492A00') OR startswith({c}, X'4D4D002A'))"
    return F.expr(f"""CASE WHEN length({c}) < 12 THEN 'unknown' WHEN startswith({c}, X'49492A00') AND {part(c, 8, 2)} = X'4352' THEN 'cr2' WHEN {part(c, 4, 8)} = X'6674797063727820' THEN 'cr3'
        WHEN NOT {tiff} THEN 'unknown' WHEN {tag_sql(c, f'{tag} = 50706')} THEN 'dng' WHEN {named('NIKON')} THEN 'nef' WHEN {named('SONY')} THEN 'arw' ELSE 'unknown' END""")


def tiff_header(content: str = "content") -> Column:
    """struct<little_endian, ifd0_offset>, null if there is no TIFF header."""
    c = f"`{content}`"
    return F.expr(f"CASE WHEN startswith({c}, X'49492A00') AND length({c}) >= 8 THEN struct(true AS little_endian, {number(c, 4, 4, 'true')} AS ifd0_offset) WHEN startswith({c}, X'4D4D002A') AND length({c}) >= 8 THEN struct(false AS little_endian, {big(c, 4, 4)} AS ifd0_offset) END")


def pdf_encrypted(content: str = "content") -> Column:
    c = f"`{content}`"
    tail = f"substring_index({latin1(c)}, 'trailer', -1)"
    pattern = r"'/Encrypt(?:\\s+[0-9]+){2}\\s+R'"
    return F.expr(f"{latin1(part(c, 0, 8192))} RLIKE {pattern} OR (contains({latin1(c)}, 'trailer') AND {tail} RLIKE {pattern})")
