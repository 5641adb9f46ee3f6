"""Secret scans with a randomness test battery, DataFrame only.

Base rules find assignments of secrets, access keys and long hex runs.  The
method looks at every run of ``MIN_RUN`` or more letters, digits and
``+ / _ -`` outside of base spans, infers its encoding from its characters
(hex, base32, base36 or base64), and tests the values in that alphabet:

* chi-squared uniformity of the alphabet,
* the runs test around the middle of the alphabet,
* lag-one serial correlation.

A run is a secret if the three tests together (Bonferroni) do not reject
randomness, and if ordinary text is rejected: its p-value is the chance that
text of that length stays in the alphabet or changes character class as often.
These p-values fall with length, and Benjamini-Hochberg over all runs of the
document holds the rate of false discoveries at ``FDR``.

Positions are code points, ends exclusive.

Defined results: null counts as empty; a document without matches has no spans;
repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name
from .sqltext import PIECE, let, quote, replaced, running_max, running_sum

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Only runs of 16 or more are kept, and a maximal run is found whole either way.
HEX = r"[0-9a-f]{16,}"
MIN_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
ALPHA, FDR = 0.001, 0.01
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Chance of a text character to lie in the alphabet of hex, and to change class.
HEX_CHANCE, CHANGE_CHANCE = 0.35, 0.1
PLACEHOLDER = "[SECRET]"


def _all(text: str, pattern: str) -> str:
    """Start, end and text of all leftmost non-overlapping matches, in order.

    The pieces between the matches and the matches themselves give the offsets.
    """
    q = quote(pattern)
    ends = running_sum("transform(m, (x, i) -> length(get(p, i)) + length(x))")
    found = let(f"split({text}, {q}, -1)", "p", let(ends, "ends", "transform(m, (x, i) -> struct(get(ends, i) - length(x) AS s, get(ends, i) AS e, x AS t))"))
    return let(f"regexp_extract_all({text}, {q}, 0)", "m", f"CASE WHEN size(m) = 0 THEN cast(array() AS array<struct<s:int,e:int,t:string>>) ELSE {found} END")


def _kind(found: str, keep: str, rank: int) -> str:
    return f"transform(filter({found}, x -> {keep}), x -> struct(x.s AS s, {rank} AS k, x.e AS e))"


def _phi(z: str) -> str:
    """The normal distribution function (Page's approximation)."""
    return f"(1D / (1D + exp(-greatest(-300D, least(300D, {let(z, 'zz', '1.5976D * zz + 0.07056D * zz * zz * zz')})))))"


def encoding(t: str) -> str:
    """SQL that names the encoding of a run, null if it looks like text."""
    return f"""CASE WHEN {t} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' AND {t} RLIKE '[a-fA-F]' AND {t} RLIKE '[0-9]' THEN 'hex'
        WHEN {t} RLIKE '^[A-Z2-7]+$' AND {t} RLIKE '[A-Z]' AND {t} RLIKE '[2-7]' THEN 'base32'
        WHEN {t} RLIKE '^([a-z0-9]+|[A-Z0-9]+)$' AND {t} RLIKE '[a-zA-Z]' AND {t} RLIKE '[0-9]' THEN 'base36'
        WHEN {t} RLIKE '[a-z]' AND {t} RLIKE '[A-Z]' AND {t} RLIKE '[0-9]' THEN 'base64' END"""


def battery(t: str, enc: str) -> str:
    """SQL struct of p_random (battery) and p_text for a run and its encoding.

    One pass over the characters, a piece at a time, sums what the tests need.
    """
    plain = "CASE enc WHEN 'base64' THEN translate(w, '-_', '+/') WHEN 'base32' THEN w ELSE lower(w) END"
    letters = "CASE enc " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, a in ALPHABETS.items()) + " END"
    squares = "aggregate(split(al, ''), 0D, (z, c) -> z + power(length(u) - length(replace(u, c, '')), 2))"
    chi = f"(a / n * {squares} - n - (a - 1)) / sqrt(2 * (a - 1) * (1 - 1 / n))"
    # s, q, c: sums of values, of their squares and of neighbours' products; h: values in the upper half; g: changes of half.
    upper = "CASE WHEN 2 * y >= a THEN 1D ELSE 0D END"
    fields = {
        "s": "z.s + y", "q": "z.q + y * y", "c": "z.c + CASE WHEN z.last < 0 THEN 0D ELSE z.last * y END", "h": f"z.h + {upper}",
        "g": "z.g + CASE WHEN z.last >= 0 AND (2 * z.last >= a) <> (2 * y >= a) THEN 1D ELSE 0D END", "first": "CASE WHEN z.last < 0 THEN y ELSE z.first END", "last": "y",
    }
    step = let("cast(instr(al, x) - 1 AS double)", "y", "struct(" + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + ")")
    none = "struct(" + ", ".join(f"{-1 if k == 'last' else 0}D AS {k}" for k in fields) + ")"
    sums = f"aggregate(regexp_extract_all(u, '.{{1,{PIECE}}}', 0), {none}, (o, part) -> aggregate(split(part, ''), o, (z, x) -> {step}))"
    runs = let("2 * v.h * (n - v.h) / n", "e", "CASE WHEN e = 0 THEN 99D ELSE (v.g - e) / sqrt(greatest(1e-9D, e * (e - 1) / (n - 1))) END")
    serial = let("v.s / n", "mu", "(v.c - mu * (2 * v.s - v.first - v.last) + (n - 1) * mu * mu) / greatest(1e-9D, v.q - n * mu * mu) * sqrt(n) + 1 / sqrt(n)")
    two = lambda z: f"2 * {_phi(f'-abs({z})')}"
    random = f"least(1D, 3 * least({_phi(f'-({chi})')}, {two(runs)}, {two(serial)}))"
    classes = "length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[a-z]+', 'l'), '[A-Z]+', 'u'), '[0-9]+', 'd'), '[+/_-]+', 's')) - 1"
    text = f"CASE WHEN enc = 'hex' THEN power({HEX_CHANCE}D, n) ELSE {_phi(f'-(({classes}) - {CHANGE_CHANCE}D * (n - 1)) / sqrt({CHANGE_CHANCE * (1 - CHANGE_CHANCE)}D * (n - 1))')} END"
    inner = let("cast(length(u) AS double)", "n", let("cast(length(al) AS double)", "a", let(sums, "v", f"struct({random} AS p_random, {text} AS p_text)")))
    return let(enc, "enc", let(t, "w", let(letters, "al", let(plain, "u", inner))))


def _free(found: str, base: str) -> str:
    """Those of the sorted, disjoint ``found`` that overlap none of ``base``.

    Starts of base spans and ends of the found ones are put in one order, in which
    the greatest base end so far tells whether one reaches into a found span.
    """
    events = "sort_array(concat(transform(b, y -> struct(y.s AS p, 1 AS g, y.e AS v)), transform(f, x -> struct(x.e AS p, 0 AS g, -1 AS v))))"
    reach = let(running_max("transform(ev, y -> y.v)"), "r", "transform(filter(transform(ev, (y, i) -> struct(y.g AS g, get(r, i) AS v)), y -> y.g = 0), y -> y.v)")
    merged = let(let(events, "ev", reach), "far", "filter(f, (x, i) -> get(far, i) <= x.s)")
    return let(base, "b", let(found, "f", f"CASE WHEN size(b) = 0 OR size(f) = 0 THEN f ELSE {merged} END"))


def _random(text: str, base: str) -> str:
    """Spans of the runs that the battery and the false-discovery control accept."""
    free = _free(_all(text, RUN), base)
    known = f"filter(transform({free}, x -> struct(x.s AS s, x.e AS e, x.t AS t, {encoding('x.t')} AS enc)), x -> x.enc IS NOT NULL)"
    tested = f"transform(h, y -> struct(y.s AS s, y.e AS e, {battery('y.t', 'y.enc')} AS p))"
    limit = f"{FDR}D * array_max(transform(sort_array(transform(d, x -> x.p.p_text)), (p, i) -> CASE WHEN p <= {FDR}D * (i + 1) / size(d) THEN i + 1 ELSE 0 END)) / size(d)"
    accepted = f"transform(filter(d, x -> x.p.p_text <= lim AND x.p.p_random >= {ALPHA}D), x -> struct(x.s AS s, 3 AS k, x.e AS e))"
    nothing = "cast(array() AS array<struct<s:int,k:int,e:int>>)"
    chosen = f"CASE WHEN size(h) = 0 THEN {nothing} ELSE {let(tested, 'd', let(limit, 'lim', accepted))} END"
    return f"CASE WHEN {text} RLIKE '[0-9]' THEN {let(known, 'h', chosen)} ELSE {nothing} END"


def scan(df: DataFrame, text_col: str = "text", base_col: str = "base_spans", all_col: str = "spans") -> DataFrame:
    """``df`` with arrays of (s, k, e): base spans and all spans, by start and kind."""
    t, low = fresh_name(df.columns, "t_"), fresh_name(df.columns, "low_")
    d = df.drop(base_col, all_col).withColumn(t, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    nothing = "cast(array() AS array<struct<s:int,k:int,e:int>>)"
    hint = f"{let(f'lower({t})', 'z', ' OR '.join(f'contains(z, {chr(39)}{w}{chr(39)})' for w in ('passw', 'secret', 'token', 'apikey', 'api_key')))}"
    assign = f"CASE WHEN {hint} THEN {_kind(_all(t, ASSIGN), f'length(regexp_extract(x.t, {quote(ASSIGN)}, 1)) >= 12', 0)} ELSE {nothing} END"
    access = f"CASE WHEN contains({t}, 'AKIA') THEN {_kind(_all(t, ACCESS), 'x.e - x.s >= 18', 1)} ELSE {nothing} END"
    d = d.withColumn(base_col, F.expr(f"sort_array(concat({assign}, {access}, {_kind(_all(t, HEX), 'true', 2)}))"))
    return d.withColumn(all_col, F.expr(f"sort_array(concat(`{base_col}`, {_random(t, f'`{base_col}`')}))")).drop(t)


def joined(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced; overlapping spans count as one."""
    spans = fresh_name(df.columns, "spans_")
    base = fresh_name([*df.columns, spans], "base_")
    d = scan(df, text_col, base, spans)
    new = replaced(f"`{text_col}`", f"`{spans}`", "s", "e", quote(PLACEHOLDER))
    return d.withColumn(text_col, F.expr(f"CASE WHEN size({spans}) > 0 THEN {new} ELSE `{text_col}` END")).select(*(F.col(f"`{c}`") for c in df.columns))
