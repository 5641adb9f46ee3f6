"""SQL text for whole-array work inside a row, without loops that copy what they have.

A fold that appends costs the square of its length, and so does cutting a long
text at every position; both are avoided here.
"""

from __future__ import annotations

#: Code points of a piece in which a text is cut.
PIECE = 1024


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, join: str, none: str) -> str:
    """All prefixes of an array joined by ``join`` (over zx and zy), in as many passes as its length has bits."""
    step = f"transform(zs, (zx, zi) -> {let(f'coalesce(get(zs, zi - shiftleft(1, zk)), {none})', 'zy', join)})"
    return let(values, "zv", f"CASE WHEN size(zv) < 2 THEN zv ELSE aggregate(sequence(0, cast(floor(log2(size(zv) - 1)) AS int)), zv, (zs, zk) -> {step}) END")


def running_sum(values: str) -> str:
    return running(values, "zx + zy", "0")


def running_max(values: str) -> str:
    return running(values, "greatest(zx, zy)", "-1")


def _part(a: str, b: str) -> str:
    """Code points a to b of the text whose pieces are ``tc``."""
    inside = f"substring(get(tc, ti), ta % {PIECE} + 1, tb - ta)"
    across = f"concat(substring(get(tc, ti), ta % {PIECE} + 1), array_join(slice(tc, ti + 2, tj - ti - 1), ''), substring(get(tc, tj), 1, tb - tj * {PIECE}))"
    body = let(f"cast(ta div {PIECE} AS int)", "ti", let(f"cast((tb - 1) div {PIECE} AS int)", "tj", f"CASE WHEN ti = tj THEN {inside} ELSE {across} END"))
    return let(f"cast({a} AS int)", "ta", let(f"cast({b} AS int)", "tb", f"CASE WHEN ta >= tb THEN '' ELSE {body} END"))


def replaced(text: str, spans: str, start: str, end: str, by: str) -> str:
    """``text`` with the spans, sorted by start, replaced by ``by`` (over tx, the span); one that overlaps an earlier one joins it."""
    pieces = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"
    before = "CASE WHEN tn = 0 THEN 0 ELSE get(tm, tn - 1) END"
    one = let(before, "tp", f"CASE WHEN tx.{start} >= tp THEN concat({_part('tp', f'tx.{start}')}, {by}) ELSE '' END")
    last = _part("element_at(tm, -1)", f"length({text})")
    made = let(running_max(f"transform(ts, tx -> tx.{end})"), "tm", f"concat(array_join(transform(ts, (tx, tn) -> {one}), ''), {last})")
    return let(spans, "ts", f"CASE WHEN size(ts) = 0 THEN {text} ELSE {let(pieces, 'tc', made)} END")
