"""Quality rules: distribution divergence against language references, DataFrame only.

Base counts come first (words, symbols, repeated lines, words in repeated
three-word windows).  The method then compares two histograms of each document
with references: its character classes, and its common words (function words of
several languages).  The reference of a language is the summed histogram of all
documents of that language; a document is compared with its own language's only,
so its verdict doesn't depend on what share of the corpus that language has.  A
language of less than ``MIN_OWN`` words has none, and no distance is judged.
The distance is Jensen-Shannon (base 2, square root).
A document fails if a distance is over a limit that is wider for short texts,
and only if the text is long enough to be judged at all.

Windows are compared by 64-bit hashes inside one document.

Defined results: null or blank text has zero counts and fails the base rule;
a null language counts as a language of its own; repeated rows get equal rows;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, stage

COMMON = sorted(set((
    "the of and to a in is it that for on with as are this by be or an at was from "
    "de la le et les des en un une du que qui dans par pour au sur est pas avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el y los del se las por para con no una su al lo "
    "di che il sono non della nel come più anche è o que do da em um não os na mais dos "
    "het een van dat op te voor met zijn niet aan och att det som på är av för till inte "
    "w z się nie jest że przez oraz i в не на что с по как это из и ve bir bu için ile çok"
).split()))
MIN_OWN, BROADCAST = 1000, 10_000
MIN_WORDS, MIN_COMMON, MIN_CHARS = 50, 10, 200
CHAR_LIMIT, CHAR_SLACK = 0.26, 0.8
WORD_LIMIT, WORD_SLACK = 0.62, 0.6

BLANK = r"[\\x20\\x09-\\x0D]+"
CLASSES = ["[a-z]+", BLANK, "[A-Z]+", "[0-9]+", r"[.,;:!?\\x27\\x22()-]+", r"[^\\x00-\\x7F]+"]
QUOTED = ", ".join(f"'{w}'" for w in COMMON)


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str) -> str:
    """Words inside three-word windows that the text holds twice or more."""
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))"
    again = "filter(s, (x, k) -> (k > 0 AND get(s, k - 1).h = x.h) OR (k < size(s) - 1 AND get(s, k + 1).h = x.h))"
    starts = f"sort_array(transform({_let('sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))', 's', again)}, x -> x.i))"
    covered = "aggregate(p, struct(-9 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)"
    return _let(words, "w", f"CASE WHEN size(w) < 4 THEN 0L ELSE {_let(hashes, 'h', f'CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_let(starts, 'p', covered)} END')} END")


def measure(df: DataFrame, text_col: str = "text", into: str = "m") -> DataFrame:
    """``df`` with a struct of counts and histograms of each text; a column of that name is replaced."""
    df = df.drop(into)
    t = fresh_name(df.columns, "t_")
    d = df.withColumn(t, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rest, left = t, []
    for k, c in enumerate(CLASSES):  # each class is taken out of what the classes before it left
        left.append(fresh_name([*df.columns, t], f"left{k}_"))
        d = d.withColumn(left[-1], F.expr(f"regexp_replace(`{rest}`, '{c}', '')"))
        rest = left[-1]
    chain = [t, *left]
    counts = [f"length(`{a}`) - length(`{b}`)" for a, b in zip(chain, left)] + [f"length(`{rest}`)"]
    w, lines, common = (fresh_name([*df.columns, *chain], x) for x in ("w_", "l_", "c_"))
    d = d.withColumn(w, F.expr(f"array_remove(split(`{t}`, '{BLANK}'), '')"))
    d = d.withColumn(lines, F.expr(rf"filter(split(`{t}`, '\\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn(common, F.expr(rf"sort_array(filter(split(lower(`{t}`), '[\\x00-\\x60\\x7B-\\x7F]+'), x -> x IN ({QUOTED})))"))
    symbols = rf"length(`{t}`) - length(regexp_replace(`{t}`, '[#*$%&|<>]+', ''))"
    hist = _let(f"`{common}`", "c", _let("array_distinct(c)", "u", _let("transform(u, x -> array_position(c, x))", "p", "struct(u AS words, transform(p, (x, i) -> coalesce(get(p, i + 1), size(c) + 1L) - x) AS counts)")))
    fields = {
        "n_words": f"cast(size(`{w}`) AS bigint)", "word_chars": f"cast(length(`{t}`) - ({counts[1]}) AS bigint)", "n_symbols": f"cast({symbols} AS bigint)",
        "n_dup_lines": f"cast(size(`{lines}`) - size(array_distinct(`{lines}`)) AS bigint)", "n_repeat_words": _repeat_words(f"`{w}`"),
        "chars": "array(" + ", ".join(f"cast({c} AS bigint)" for c in counts) + ")", "hist": hist,
    }
    return d.select(*(F.col(f"`{c}`") for c in df.columns), F.struct(*(F.expr(x).alias(k) for k, x in fields.items())).alias(into))


def references(measured: DataFrame, lang_col: str = "lang", m: str = "m") -> DataFrame:
    """lang, n_words, ref: the histograms of every language with at least MIN_OWN words, as shares; null is a language too."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang")
    d, sizes = measured.select(lang, m), range(len(CLASSES) + 1)
    chars = d.groupBy("lang").agg(F.sum(f"{m}.n_words").alias("n_words"), F.array(*(F.sum(F.col(f"{m}.chars")[k]) for k in sizes)).alias("c")).where(F.col("n_words") >= MIN_OWN)
    words = d.select("lang", F.explode(F.arrays_zip(f"{m}.hist.words", f"{m}.hist.counts")).alias("x")).groupBy("lang", F.col("x.words").alias("w")).agg(F.sum("x.counts").alias("n"))
    words = words.groupBy("lang").agg(F.sum("n").alias("all"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", "n")))).alias("ns"))
    shares = "transform(c, x -> x / aggregate(c, 0L, (s, y) -> s + y))"
    parts = "coalesce(transform_values(ns, (w, x) -> x / all), map_from_arrays(cast(array() AS array<string>), cast(array() AS array<double>)))"
    return stage(chars.join(words, "lang", "left").select("lang", "n_words", F.expr(f"struct({shares} AS chars, {parts} AS words)").alias("ref")), "references")


def with_reference(measured: DataFrame, refs: DataFrame, lang_col: str, ref: str) -> DataFrame:
    """``measured`` with the reference of each document's language, null if it has none.

    The table of references is sent to every task up to BROADCAST languages.
    Beyond, that many with the most words are, and the documents of the others,
    each of which has less than 1 / BROADCAST of the words, are shuffled.
    """
    key = fresh_name([*measured.columns, ref], "key_")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
    named = refs.select(F.col("lang").alias(key), F.col("ref").alias(ref), "n_words")
    if refs.count() <= BROADCAST:
        return measured.join(F.broadcast(named.drop("n_words")), lang == F.col(key), "left").drop(key)
    large = stage(named.orderBy(F.desc("n_words"), key).limit(BROADCAST).drop("n_words"), "large")
    d = measured.join(F.broadcast(large), lang == F.col(key), "left").drop(key)
    rest = named.drop("n_words").join(F.broadcast(large.select(key)), key, "left_anti")
    others = d.where(F.col(ref).isNull()).drop(ref).join(rest, lang == F.col(key), "left").drop(key)
    return d.where(F.col(ref).isNotNull()).unionByName(others)


def _term(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0D END + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0D END) / 2"


def judge(measured: DataFrame, refs: DataFrame, m: str = "m", prefix: str = "", lang_col: str = "lang") -> DataFrame:
    """``measured`` with char_distance, word_distance, base_failed and kept, each after ``prefix``."""
    r = fresh_name(measured.columns, "ref_")
    d = with_reference(measured, refs, lang_col, r)
    add = "0D, (s, x) -> s + x"
    n_chars = f"aggregate({m}.chars, 0L, (s, x) -> s + x)"
    n_common = f"aggregate({m}.hist.counts, 0L, (s, x) -> s + x)"
    by_char = f"aggregate(zip_with({m}.chars, `{r}`.chars, (x, b) -> {_let('x / n', 'a', _term('a', 'b'))}), {add})"
    q = f"coalesce(`{r}`.words[w], 0D)"
    terms = f"zip_with({m}.hist.words, {m}.hist.counts, (w, x) -> {_let('struct(x / n AS p, ' + q + ' AS q)', 'z', _term('z.p', 'z.q'))})"
    absent = f"0.5D * (1D - aggregate(transform({m}.hist.words, w -> {q}), {add}))"
    far = lambda n, by, least: F.expr(f"CASE WHEN `{r}` IS NOT NULL AND {n} >= {least} THEN {_let(n, 'n', f'sqrt(greatest(0D, {by}))')} END")
    d = d.withColumn(f"{prefix}char_distance", far(n_chars, by_char, MIN_CHARS)).withColumn(f"{prefix}word_distance", far(n_common, f"aggregate({terms}, {add}) + {absent}", MIN_COMMON)).drop(r)
    base = (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))
    odd_chars = F.coalesce(F.col(f"{prefix}char_distance") > F.expr(f"{CHAR_LIMIT} + {CHAR_SLACK} / sqrt({n_chars})"), F.lit(False))
    odd_words = F.coalesce(F.col(f"{prefix}word_distance") > F.expr(f"{WORD_LIMIT} + {WORD_SLACK} / sqrt({n_common})"), F.lit(False))
    return d.withColumn(f"{prefix}base_failed", base).withColumn(f"{prefix}kept", ~base & ~odd_chars & ~odd_words)


def quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without its text column, with the struct m, both distances and the verdicts."""
    measured = stage(measure(df, text_col).drop(text_col), "measured")
    return judge(measured, references(measured, lang_col), lang_col=lang_col)


def _sql_term(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0 END) / 2"


_N = len(CLASSES) + 1
_SETS = ["a-z", r"\x20\x09-\x0D", "A-Z", "0-9", r".,;:!?\x27\x22()-"]
_COUNTS = [*(f"length(regexp_replace(t, '[^{s}]', '', 'g'))" for s in _SETS), r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"]
_COUNTS.append("length(t) - (" + " + ".join(_COUNTS) + ")")
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, doc_id, lang, length(t) AS n_chars, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, {", ".join(f"{c} AS c{k}" for k, c in enumerate(_COUNTS))} FROM d),
g AS (SELECT r, s, array_to_string(list_slice(w, s, s + 2), ' ') AS win FROM a, unnest(generate_series(1, len(w) - 2)) AS q(s)),
g2 AS (SELECT r, s, count(*) OVER (PARTITION BY r, win) AS n FROM g),
rep AS (SELECT r, count(DISTINCT s + k) AS n FROM g2, unnest([0, 1, 2]) AS q(k) WHERE n > 1 GROUP BY r),
cw AS (SELECT r, lang, w, count(*) AS n FROM (SELECT r, lang, unnest(regexp_split_to_array(lower(t), '[\x00-\x60\x7B-\x7F]+')) AS w FROM d) WHERE w IN ({QUOTED}) GROUP BY ALL),
lc AS (SELECT lang, sum(len(w)) AS n, {", ".join(f"sum(c{k}) AS c{k}" for k in range(_N))} FROM a GROUP BY lang),
refs AS (SELECT lang, {", ".join(f"c{k} / ({' + '.join(f'c{j}' for j in range(_N))}) AS q{k}" for k in range(_N))} FROM lc WHERE n >= {MIN_OWN}),
rw0 AS (SELECT lang, w, sum(n) AS n FROM cw GROUP BY lang, w),
rw AS (SELECT lang, w, n / sum(n) OVER (PARTITION BY lang) AS q FROM rw0),
cd AS (SELECT r, {" + ".join(_sql_term(f"(c{k} / n_chars)", f"q{k}") for k in range(_N))} AS x FROM a JOIN refs USING (lang) WHERE n_chars >= {MIN_CHARS}),
tot AS (SELECT r, sum(n) AS n FROM cw GROUP BY r),
wd0 AS (SELECT cw.r, cw.n / tot.n AS p, rw.q FROM cw JOIN tot USING (r) JOIN refs USING (lang) JOIN rw ON rw.lang = cw.lang AND rw.w = cw.w WHERE tot.n >= {MIN_COMMON}),
wd AS (SELECT r, sum({_sql_term("p", "q")}) + 0.5 * (1 - sum(q)) AS x FROM wd0 GROUP BY r),
b AS (SELECT a.*, coalesce(rep.n, 0) AS reps, tot.n AS n_common, sqrt(greatest(0, cd.x)) AS cx, sqrt(greatest(0, wd.x)) AS wx,
    len(w) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM a LEFT JOIN rep USING (r) LEFT JOIN tot USING (r) LEFT JOIN cd USING (r) LEFT JOIN wd USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(reps AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(cx > {CHAR_LIMIT} + {CHAR_SLACK} / sqrt(n_chars), false) AND NOT coalesce(wx > {WORD_LIMIT} + {WORD_SLACK} / sqrt(n_common), false) AS kept
FROM b
"""
