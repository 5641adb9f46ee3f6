"""Benchmark decontamination by a prefix-filtered containment join, DataFrame only.

A window is a run of ``WINDOW`` words of an item, or all words of a shorter
item; a document holds it if the words occur in a row.  Containment is whole,
so one shingle of the window is a sufficient prefix: the rarest one by its
count over all documents.  A document position whose shingle is the prefix of
some window fixes where that window would start (the positional bound) and end
(the length bound); the words there are then compared exactly.

The benchmark side is cut into blocks of about ``BLOCK_BYTES`` of window text,
window by window, so a long item is in all of them; each block is broadcast.
Documents are scanned once a block and never shuffled.

Defined results: null text has no words; a document or item without words is in
no match; repeated rows each get their own row; null ids are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW, SHINGLE = 13, 3
BLOCK_BYTES = 24 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    found = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win, len: the distinct windows of each item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.expr(f"explode(sequence(1, greatest(1, size(w) - {window - 1})))")
    return w.select("item_id", "w", starts.alias("at")).select("item_id", F.expr(f"slice(w, at, {window})").alias("win")).distinct().withColumn("len", F.size("win"))


def _shingle(words_col: str, at: str, n: int) -> Column:
    """Hash of ``n`` words from zero-based position ``at``; its length is part of it."""
    return F.expr(f"xxhash64({n}, " + ", ".join(f"get({words_col}, {at} + {k})" for k in range(n)) + ")")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, item_id, start, len: every occurrence of a window, once."""
    wins = stage(windows(items.select("item_id", "text"), window), "windows")
    # Every shingle of every window, and how often the documents have it.
    own = wins.withColumn("s", F.least(F.col("len"), F.lit(shingle))).select("item_id", "win", "len", "s", F.expr("explode(sequence(0, len - s))").alias("o"))
    h = reduce(lambda c, n: c.when(F.col("s") == n, _shingle("win", "o", n)), range(1, shingle), F.when(F.col("s") == shingle, _shingle("win", "o", shingle)))
    own = own.withColumn("h", h)
    size = wins.agg(F.coalesce(F.sum(F.length(F.array_join("win", " ")) + 80), F.lit(0)), F.sort_array(F.collect_set(F.least("len", F.lit(shingle))))).first()
    blocks = 1 + int(size[0]) // BLOCK_BYTES
    lengths = list(size[1])
    if not lengths:
        lengths = [shingle]

    base = docs.select("doc_id", F.xxhash64("text").alias("fp"), words(F.col("text")).alias("w"))
    spread = base.select("doc_id", "fp", "w", F.posexplode("w").alias("pos", "word"))
    spread = reduce(DataFrame.union, [spread.select("doc_id", "fp", "w", "pos", _shingle("w", "pos", n).alias("h")) for n in lengths])
    of_block = lambda d, k: d if blocks == 1 else d.where(F.pmod(F.xxhash64("item_id", "win"), F.lit(blocks)) == k)

    counts = [spread.select("h").join(F.broadcast(of_block(own, k).select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("n")) for k in range(blocks)]
    rarity = stage(reduce(DataFrame.union, counts).groupBy("h").agg(F.max("n").alias("n")), "rarity")
    # A window with a shingle that no document has can't occur; the others keep their rarest shingle.
    ranked = own.join(rarity, "h", "left").groupBy("item_id", "win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("m"))
    prefixes = stage(ranked.where("m.n > 0").select("item_id", "win", "len", F.col("m.h").alias("h"), F.col("m.o").alias("o")), "prefixes")

    found = []
    for k in range(blocks):
        near = spread.join(F.broadcast(of_block(prefixes, k)), "h").where("pos >= o and pos - o + len <= size(w)")
        found.append(near.where("slice(w, pos - o + 1, len) = win").select("doc_id", "fp", "item_id", F.expr("pos - o").alias("start"), "len"))
    return reduce(DataFrame.union, found).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, per_cent: int = 5) -> DataFrame:
    """One row for each document: n_words, n_hit, items (sorted ids), contaminated, and whole: a window of full length occurs."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    h = stage(hits(docs, items, window, shingle), "hits")
    spots = h.select("doc_id", "fp", F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct().groupBy("doc_id", "fp").agg(F.count("*").alias("n_hit"))
    named = h.groupBy("doc_id", "fp", F.col("item_id").cast("string").alias("item")).agg(F.max("len").alias("len"))
    named = named.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list("item")).alias("items"), (F.max("len") >= window).alias("whole"))
    # Null ids are joined like any other value.
    key = lambda d: d.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).drop("doc_id")
    out = docs.select("doc_id", F.xxhash64("text").alias("fp"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = out.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    out = out.join(key(spots).join(key(named), ["k", "fp"]), ["k", "fp"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (100 * n_hit >= per_cent * F.col("n_words"))).alias("contaminated"), F.coalesce("whole", F.lit(False)).alias("whole"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + 12), ' ') AS win
    FROM i, unnest(generate_series(1, greatest(1, len(w) - 12))) AS g(s) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM d, ns, unnest(generate_series(1, len(w) - n + 1)) AS g(s)),
h AS (SELECT DISTINCT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM h, unnest(generate_series(s, s + n - 1)) AS g(q) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)
"""
