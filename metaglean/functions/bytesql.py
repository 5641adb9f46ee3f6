"""SQL fragments over a BINARY column; positions are zero-based byte offsets."""

from __future__ import annotations


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hexed(data: bytes) -> str:
    return f"X'{data.hex().upper()}'"


def latin1(c: str) -> str:
    """The bytes as characters U+0000 to U+00FF, so that character positions are byte positions."""
    return f"decode({c}, 'ISO-8859-1')"


def part(c: str, at: str | int, n: str | int) -> str:
    return f"substring({c}, {at} + 1, {n})"


def matches_at(c: str, at: str | int, data: bytes) -> str:
    return f"{part(c, at, len(data))} = {hexed(data)}"


def index_of(c: str, data: bytes, start: str | int = 0) -> str:
    """First position at or after ``start``, -1 if there is none."""
    return f"(locate({latin1(hexed(data))}, {latin1(c)}, {start} + 1) - 1)"


def big(c: str, at: str | int, n: int) -> str:
    """Unsigned big-endian number of ``n`` bytes; null past the end."""
    return f"(CASE WHEN {at} + {n} <= length({c}) THEN cast(conv(hex({part(c, f'cast({at} AS int)', n)}), 16, 10) AS bigint) END)"


def little(c: str, at: str | int, n: int) -> str:
    pieces = ", ".join(f"hex({part(c, f'cast({at} AS int) + {k}', 1)})" for k in reversed(range(n)))
    return f"(CASE WHEN {at} + {n} <= length({c}) THEN cast(conv(concat({pieces}), 16, 10) AS bigint) END)"


def number(c: str, at: str | int, n: int, le: str) -> str:
    """Either byte order, chosen by the boolean ``le``."""
    return f"(CASE WHEN {le} THEN {little(c, at, n)} ELSE {big(c, at, n)} END)"


def packed(value: str, n: int) -> str:
    """A number as ``n`` big-endian bytes."""
    return f"unhex(lpad(hex({value}), {2 * n}, '0'))"


def packed_little(value: str, n: int) -> str:
    digits = f"lpad(hex({value}), {2 * n}, '0')"
    return "unhex(concat(" + ", ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in reversed(range(n))) + "))"


def blanked(c: str, at: str | int, n: str | int, byte: str = "00") -> str:
    """``c`` with ``n`` bytes replaced, of the same length."""
    return f"overlay({c} PLACING unhex(repeat('{byte}', {n})) FROM {at} + 1 FOR {n})"


def is_blank(c: str, at: str | int, n: str | int) -> str:
    return f"{part(c, at, n)} = unhex(repeat('00', {n}))"


def png_crc(kind: str, data: str) -> str:
    return f"crc32(concat({kind}, {data}))"


def let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
