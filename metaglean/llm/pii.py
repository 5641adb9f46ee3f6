"""Personal data with information-theoretic sanitisation.

Base rules find e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers; each distinct value is a protected entity.  The method then asks which
ordinary terms give an entity away.  For the terms within ``WINDOW`` words of
its mentions it counts, over all documents,

* n(e, t): documents with t near a mention of e,
* n(e), n(t), N: documents with e, with t anywhere, and all of them,

and flags t if P(e | t) = n(e, t) / n(t) is at least ``CONFIDENCE``, the
pointwise mutual information log2(N n(e, t) / (n(e) n(t))) at least ``SHARE`` of
the most it can be, -log2(n(e, t) / N), which holds for an entity in a third of
all documents as for a rare one, and at least ``SUPPORT`` different texts show
the pair (so copies of one text prove nothing).  Flagged terms are spans of kind
``term`` wherever they stand.

Only candidate terms (pairs with support) are counted over the corpus.  Up to
``BLOCK`` of them are sent to every task, which counts them in one scan; more are
counted by a shuffle of the words of every document, summed up in each task
first.  Likewise flagged terms are found in texts in one scan, or else by a join
of words with terms, and of their places with the texts by a 128-bit hash.  Terms
are compared by 64-bit hashes.

Positions are code points, ends exclusive.  Defined results: null counts as
empty; no documents with personal data mean no terms; repeated rows get equal
rows and count as one text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, ship, stage
from .sqltext import replaced
from .textvec import LOWER, U, chunks, prefix_sums, span_hash, string_bytes, word_spans

KINDS = ["email", "ip", "card", "phone", "term"]
WINDOW, SUPPORT, CONFIDENCE, SHARE = 6, 3, 0.5, 0.5
MIN_TERM = 3
#: Hashes that are sent to every task, at most.
BLOCK = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: A maximal run of digits with single blanks or hyphens between; shorter ones can't pass.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9].{6}", re.S)
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
SEP = np.ones(256, bool)
SEP[48:58] = SEP[65:91] = SEP[97:123] = SEP[128:] = False
PLACEHOLDERS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind and start."""
    out, done, i = [], 0, t.find("@")
    while i >= 0:
        m = DOMAIN.match(t, i + 1)
        if m:
            s = i
            while s > done and t[s - 1] in LOCAL:
                s -= 1
            if s < i:
                out.append((0, s, m.end()))
                done = m.end()
        i = t.find("@", max(i + 1, done))
    for m in IP.finditer(t):
        if all(int(x) <= 255 if len(x) < 20 else int(x.lstrip("0")[:20] or "0") <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entity(kind: int, value: str) -> str:
    """The protected value of a mention, whatever its spelling."""
    return f"{kind}:{value.lower() if kind == 0 else re.sub('[^0-9.]' if kind == 1 else '[^0-9]', '', value)}"


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and each document's first word."""
    low = LOWER[data]
    s, e, first = word_spans(low, offsets, SEP)
    return s, e, span_hash(prefix_sums(low), s, e), first


def _touched(s: np.ndarray, e: np.ndarray, starts: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words, by their bytes, overlap one of the spans, given in code points that start at these bytes."""
    edge = np.zeros(len(s) + 1, np.int64)
    if spans and len(s):
        a, b = starts[[x for _, x, _ in spans]], starts[[x for _, _, x in spans]]
        np.add.at(edge, np.searchsorted(e, a, "right"), 1)
        np.add.at(edge, np.maximum(np.searchsorted(s, b, "left"), np.searchsorted(e, a, "right")), -1)
    return np.cumsum(edge[:-1]) > 0


def mentions(docs: DataFrame) -> DataFrame:
    """entity, term, text: hashes of what stands near each mention; term null for the mention itself."""

    def of_text(t: str) -> Iterator[tuple[str, int | None]]:
        spans = base_spans(t)
        if not spans:
            return
        raw = np.frombuffer(t.encode(), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each code point
        starts = np.append(starts, len(raw))
        s, e, h, _ = _hash_words(raw, np.array([0, len(raw)]))
        free = np.flatnonzero(~_touched(s, e, starts, spans) & (e - s >= MIN_TERM))
        at = s[free]
        for kind, a, b in spans:
            name = entity(kind, t[a:b])
            yield name, None
            left, right = np.searchsorted(at, starts[a]), np.searchsorted(at, starts[b])
            for k in np.concatenate([free[max(0, left - WINDOW) : left], free[right : right + WINDOW]]).tolist():
                yield name, int(h[k].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, terms, rows = [], [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                if t and ("@" in t or DIGITS.search(t)):
                    for name, term in set(of_text(t)):
                        names.append(name)
                        terms.append(term)
                        rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(terms, pa.int64()), batch.column(1).take(pa.array(rows, pa.int64()))], ["entity", "term", "text"])

    return docs.select("text", F.xxhash64("text").alias("fp")).mapInArrow(run, "entity string, term long, text long")


def _few(hashes: DataFrame) -> np.ndarray | None:
    """The sorted hashes if they are at most BLOCK, else None."""
    rows = hashes.limit(BLOCK + 1).collect()
    return None if len(rows) > BLOCK else np.sort(np.array([r[0] for r in rows], np.int64).view(U))


def _document_counts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """term, n_t: documents that hold each of the hashes."""
    few = _few(hashes)
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(0 if wanted is None else len(wanted), np.int64)
        for batch in batches:
            data, offsets = string_bytes(batch.column(0))
            for _, _, part, offs in chunks(data, offsets):
                _, _, h, first = _hash_words(part, offs)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                if wanted is None:  # every word of each document once; the sums follow in the task
                    order = np.lexsort((row, h))
                    new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])[: len(h)])
                    terms, n = np.unique(h[order[new]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])
                elif len(wanted):
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    hit = np.flatnonzero(wanted[at] == h)
                    pairs = np.unique(row[hit] * len(wanted) + at[hit])
                    total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted if few is not None else counted.join(hashes, "term", "left_semi")


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """entity, term, n_et, n_e, n_t, confidence, bits of the pairs over all thresholds."""
    near = stage(mentions(docs), "mentions")
    n_e = near.where("term is null").groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = near.where("term is not null").groupBy("entity", "term", "text").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    pairs = stage(pairs.join(n_e, "entity"), "pairs")
    counted = stage(_document_counts(docs, pairs.select("term").distinct()), "counts")
    share = F.col("n_et") / F.lit(float(max(1, docs.count())))
    d = pairs.join(counted, "term").withColumn("confidence", F.col("n_et") / F.col("n_t"))
    d = d.withColumn("bits", F.log2(F.col("n_et") / share * F.col("n_et") / F.col("n_e") / F.col("n_t")))
    enough = (F.col("confidence") >= CONFIDENCE) & (F.col("bits") > 0) & (F.col("bits") >= -SHARE * F.log2(share))
    return d.where(enough).select("entity", "term", "n_et", "n_e", "n_t", "confidence", "bits")


SPANS = "array<struct<kind:int,start:int,end:int>>"


def scan(df: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with an array of (kind, start, end): base spans, then disclosing terms."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    flagged = stage(disclosing_terms(df.select(text.alias("text"))).select("term").distinct(), "flagged")
    few = _few(flagged)
    d = df.drop(into)
    t, x, y, z = (fresh_name([*d.columns, into], f"{c}_") for c in "txyz")
    d = d.withColumn(t, text)
    if few is not None:
        d = _marked(d, few, into)
    else:
        key = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))
        found = _places(d.select(F.col(t).alias("text"))).join(flagged, "term", "left_semi")
        found = found.groupBy(F.col("x").alias(x), F.col("y").alias(y)).agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end")).alias(z))
        d = _marked(d, np.zeros(0, U), into, True).withColumns(dict(zip((x, y), key(t)))).join(found, [x, y], "left")
        d = d.withColumn(into, F.expr(f"CASE WHEN `{z}` IS NULL THEN `{into}` ELSE sort_array(concat(`{into}`, `{z}`)) END"))
    return d.select(*(F.col(f"`{c}`") for c in df.columns if c != into), into)


def _free_words(column: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[int, list[int], list[int], np.ndarray, list[tuple[int, int, int]]]]:
    """For each text its row, starts, ends and hashes of (wanted) words outside of base spans, and the base spans; positions in code points."""
    texts = column.to_pylist()
    data, offsets = string_bytes(column)
    for at, end, part, offs in chunks(data, offsets):
        s, e, h, first = _hash_words(part, offs)
        use = e - s >= MIN_TERM
        if wanted is not None:
            use &= (wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h) if len(wanted) else False
        for r in range(at, end):
            spans = base_spans(texts[r])
            i = np.flatnonzero(use[first[r - at] : first[r - at + 1]]) + first[r - at]
            if not len(i):
                yield r, [], [], h[:0], spans
                continue
            a = offs[r - at]
            points = np.cumsum((part[a : offs[r - at + 1]] & 0xC0) != 0x80)
            starts = np.append(np.flatnonzero((part[a : offs[r - at + 1]] & 0xC0) != 0x80), offs[r - at + 1] - a)
            i = i[~_touched(s[i] - a, e[i] - a, starts, spans)]
            yield r, (points[s[i] - a] - 1).tolist(), points[e[i] - a - 1].tolist(), h[i], spans


def _places(d: DataFrame) -> DataFrame:
    """x, y (hashes of the text), term, start, end: every word outside of base spans of the different texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for r, starts, ends, h, _ in _free_words(batch.column(0), None):
                k = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                if k in seen or not starts:
                    continue
                seen.add(k)
                n = len(starts)
                columns = [pa.array(np.full(n, k[0])), pa.array(np.full(n, k[1])), pa.array(h.view(np.int64)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["x", "y", "term", "start", "end"])

    return d.select("text", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).mapInArrow(run, "x long, y long, term long, start int, end int")


def _marked(d: DataFrame, terms: np.ndarray, into: str, keep_text: bool = False) -> DataFrame:
    """Adds the base spans and those of the terms in the last column, the text."""
    kept = d.columns if keep_text else d.columns[:-1]
    shared = d.sparkSession.sparkContext.broadcast(terms)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = ", ".join([*(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept), f"`{into}` {SPANS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, rows = [0], []
            for _, starts, ends, _, spans in _free_words(batch.column(batch.num_columns - 1), shared.value):
                rows += sorted([*spans, *((4, a, b) for a, b in zip(starts, ends))])
                offs.append(len(rows))
            flat = [pa.array([x[i] for x in rows], pa.int32()) for i in range(3)]
            values = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.StructArray.from_arrays(flat, ["kind", "start", "end"]), kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), values], [*kept, into])

    return d.mapInArrow(run, schema)


def joined(spans: str, most: int = len(KINDS)):
    """The spans of the first ``most`` kinds as kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(filter({spans}, x -> x.kind < {most}), x -> concat(get({names}, x.kind), ':', x.start, ':', x.end)), ',')")


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by the name of its kind; overlapping spans count as one."""
    spans = fresh_name(df.columns, "spans_")
    names = "array(" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + ")"
    order = f"array_sort({spans}, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE a.kind - b.kind END)"
    d = scan(df, text_col, spans)
    new = replaced(f"`{text_col}`", order, "start", "end", f"get({names}, tx.kind)")
    return d.withColumn(text_col, F.expr(f"CASE WHEN size({spans}) > 0 THEN {new} ELSE `{text_col}` END")).select(*(F.col(f"`{c}`") for c in df.columns))
