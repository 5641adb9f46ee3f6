"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds its distinct shingles; one 64-bit hash orders all
shingles of the corpus, and a sketch is the ``K`` smallest hashes of a set.
Documents of Jaccard similarity 0.8 or more hold nearly the same smallest
hashes, so some ``RUN`` neighbours of the merged order are in both and are
neighbours in both sketches.  Inverted lists are therefore kept by runs of
``RUN`` retained values: for sets that fit in their sketch such a run exists
for certain (four or more of any five hashes agree), for larger ones it is
missed with a chance of about ``0.695 ** K`` a pair (3e-8), and only at the
very threshold.

1. Equal sets become one class at once (grouped by a 128-bit digest).
2. Round one links every member of an inverted list to the list's smallest
   document only, so a list of n copies costs n - 1 pairs.
3. Candidates pass if the sketch of the union makes 0.8 plausible, and are then
   confirmed on full sets, from the texts.
4. Components of confirmed links come from alternating large-star and
   small-star steps on tables.
5. Round two takes the lists whose members are still in different components.
   Of short lists it checks the pairs across components, so no link is lost that
   could join two of them.  Documents of longer lists (more than ``LIST_LIMIT``)
   are joined anew by prefixes of their full sets, rarest shingles first, which
   is exact and lets a passage of very many documents form no list.  There, the
   smaller set of a pair needs a shorter prefix than the larger one, so most
   members of a list only meet those few; and a pair counts only if the places
   of its common shingle leave room for a similarity of 0.8.  A template that is
   most of many documents, none of them similar, thus pairs none of them.  Their
   lists are settled by heads first too.

Defined results: null or blank text has an empty set, links with nothing and
stays; a null id links with nothing and stays; rows of one id are one document;
ties go to the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, ship, stage
from .textvec import LOWER, SPACE, U, chunks, mix, prefix_sums, shingle_hash, span_hash, string_bytes, word_spans

K, RUN = 48, 3
#: Six standard deviations below 0.8 for a union sketch of K values.
PLAUSIBLE = 0.8 - 6 * (0.16 / K) ** 0.5
#: Ids of candidates that are broadcast to thin the text scan; beyond it, a shuffled join does that.
BROADCAST_IDS = 250_000
#: Lists up to this size are paired in round two; documents of longer ones are joined by prefixes.
LIST_LIMIT = 64
#: Shingles that sets of sizes x and y have in common if their similarity is 0.8, and as its share of y if x is not smaller.
LEAST, OWN = "(4 * ({x} + {y}) + 8) div 9", "(8 * {x} + 8) div 9"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    low = LOWER[data]
    s, e, first = word_spans(low, offsets, SPACE)
    words = span_hash(prefix_sums(low), s, e)
    runs = shingle_hash(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield shingle_hash(words[a:b], b - a) ^ U(b - a)
        else:
            yield np.zeros(0, U)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch (K smallest hashes as bytes)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for at, end, part, offs in chunks(data, offsets):
                sizes, digests, kept = [], [], []
                for x in shingle_sets(part, offs, shingle):
                    sizes.append(len(x))
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    kept.append(x[:K].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_bytes(column)
    return np.frombuffer(data.tobytes(), U), offsets // 8


def postings(reps: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles: one row for each run of retained values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offs = _rows(batch.column(2))
            of = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            keys, rows = [], []
            for size in (RUN, 2, 1):
                m = len(values) - size + 1
                if m <= 0:
                    continue
                same = of[:m] == of[size - 1 :]
                if size < RUN:  # sets of up to five: a run of RUN common values is not certain
                    same &= np.diff(offs)[of[:m]] <= (5 if size == 2 else 2)
                x = values[:m].copy()
                for k in range(1, size):
                    x = mix(x) + values[k : k + m]
                keys.append(mix(x + U(size))[same])
                rows.append(of[:m][same])
            key, row = np.concatenate(keys), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "doc_id", "n_shingles"])

    return reps.select("doc_id", "n_shingles", "sketch").mapInArrow(run, "key long, doc_id long, n_shingles long")


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by the sketch of their union; exact if both are whole."""
    both = np.concatenate([a, b])
    both.sort()
    k = min(K, len(both)) if len(a) == K or len(b) == K else len(both)
    equal = both[1:] == both[:-1]
    place = np.flatnonzero(np.concatenate([[True], ~equal]))  # firsts of distinct values
    k = min(k, len(place))
    last = place[k] if k < len(place) else len(both)
    return float(equal[: last - 1].sum()) / max(k, 1)


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, sure: pairs whose union sketch allows 0.8; sure if it decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, oa = _rows(batch.column(2))
            vb, ob = _rows(batch.column(3))
            n, keep, sure = batch.num_rows, [], []
            for i in range(n):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                whole = len(x) < K and len(y) < K
                if whole:
                    common = len(np.intersect1d(x, y, True))
                    ok = 100 * common >= 80 * (len(x) + len(y) - common)
                else:
                    ok = estimate(x, y) >= PLAUSIBLE
                keep.append(ok)
                sure.append(whole)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sure, pa.bool_())], ["a", "b", "sure"])
            yield out.filter(pa.array(keep, pa.bool_()))

    a, b = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, sure boolean")


def _confirm(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs whose full sets have similarity 0.8 or more."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = _wanted(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # sorted by a: its set is at hand for all its partners
        for batch in batches:
            keep = []
            ids_a = batch.column(0).to_pylist()
            da, oa = string_bytes(batch.column(2))
            db, ob = string_bytes(batch.column(3))
            sets_b = (x for _, _, part, offs in chunks(db, ob) for x in shingle_sets(part, offs, shingle))
            for i, (a, y) in enumerate(zip(ids_a, sets_b)):
                if a not in known:
                    known = {a: next(shingle_sets(da[oa[i] : oa[i + 1]], np.array([0, oa[i + 1] - oa[i]]), shingle))}
                x = known[a]
                common = len(np.intersect1d(x, y, True))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Confirmed links among candidate pairs."""
    likely = stage(_plausible(pairs, reps), "likely")
    rest = likely.where("not sure")
    return likely.where("sure").select("a", "b").union(_confirm(rest, docs, shingle))


def components(edges: DataFrame) -> DataFrame:
    """node, component: smallest reachable id of each node with an edge.

    Alternates large-star and small-star steps, each written to the shared
    folder, until the set of edges stays as it is.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        fewer = stage(small, "small")
        drop_stage(edges)
        drop_stage(large)
        edges = fewer
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``df``."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = stage(sketches(docs, shingle=shingle), "sketches")
    usable = every.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = usable.join(classes, "digest").where("doc_id = rep").select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"])
    reps = stage(reps, "reps")

    # An id with several texts is one document: its classes share their smallest id.
    own = usable.join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    own = own.join(reps.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")

    lists = _lists(postings(reps), "lists")
    tested = stage(_star(lists), "star")
    found = stage(links(tested, reps, docs, shingle).union(own), "links1")
    labels = stage(components(found), "labels")

    open_lists = _unsettled(lists, labels)
    pairs = _crossing(open_lists.where(F.col("size") <= LIST_LIMIT))
    long_docs = stage(open_lists.where(F.col("size") > LIST_LIMIT).select("doc_id").distinct(), "long")
    rest = None
    if not long_docs.isEmpty():
        rest = _lists(prefixes(docs, long_docs, shingle), "prefix_lists")
        pairs = pairs.union(_star(rest.where(_room("rank", "n_shingles", "head_rank", "head_n")))).distinct()
    pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs2")
    found, labels = _more(pairs, found, labels, reps, docs, shingle)
    if rest is not None:
        last = stage(_crossing_prefixes(_unsettled(rest, labels)).join(tested.union(pairs), ["a", "b"], "left_anti"), "pairs3")
        found, labels = _more(last, found, labels, reps, docs, shingle)

    named = classes.join(labels, classes.rep == labels.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("digest")).alias("digest")).join(named, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _lists(p: DataFrame, what: str) -> DataFrame:
    """The postings of keys with two documents or more, with size and head (smallest document) of their list."""
    p = stage(p, what + "_postings")
    own = [c for c in p.columns if c != "key"]
    heads = p.groupBy("key").agg(F.min(F.struct(*own)).alias("h"), F.count("*").alias("size")).where("size > 1")
    named = {"doc_id": "head", "n_shingles": "head_n", "rank": "head_rank"}
    out = stage(p.join(heads.select("key", "size", *(F.col(f"h.{c}").alias(named[c]) for c in own)), "key"), what)
    drop_stage(p)
    return out


def _fits(x: str, y: str):
    """Sizes that allow a similarity of 0.8."""
    return 100 * F.least(F.col(x), F.col(y)) >= 80 * F.greatest(F.col(x), F.col(y))


def _star(lists: DataFrame) -> DataFrame:
    """Pairs of each list's head and its members: as many as members, not as their square."""
    return lists.where("doc_id <> head").where(_fits("n_shingles", "head_n")).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()


def _unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists whose members are in several components, with the component of each member."""
    rank = [c for c in ("rank",) if c in lists.columns]
    placed = lists.join(labels, lists.doc_id == labels.node, "left").select("key", "size", "doc_id", "n_shingles", *rank, F.coalesce("component", "doc_id").alias("component"))
    placed = stage(placed, "placed")
    keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    out = stage(placed.join(keys, "key"), "unsettled")
    drop_stage(placed)
    return out


def _crossing(unsettled: DataFrame) -> DataFrame:
    """Pairs of one list and of different components, each once."""
    a = unsettled.select("key", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("component").alias("ca"))
    b = unsettled.select("key", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb"))
    return a.join(b, "key").where("a < b and ca <> cb").where(_fits("na", "nb")).select("a", "b").distinct()


def _room(rx: str, nx: str, ry: str, ny: str):
    """Whether a first common shingle at these places (from 1) leaves enough behind it for a similarity of 0.8."""
    least = LEAST.format(x=nx, y=ny)
    return F.expr(f"{rx} <= {nx} - {least} + 1 AND {ry} <= {ny} - {least} + 1")


def _crossing_prefixes(unsettled: DataFrame) -> DataFrame:
    """Like _crossing, of lists of prefixes: the smaller set of a pair (or smaller id) is in its own, shorter prefix."""
    a = unsettled.where(f"rank <= n_shingles - {OWN.format(x='n_shingles')} + 1")
    a = a.select("key", F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("rank").alias("rx"), F.col("component").alias("cx"))
    b = unsettled.select("key", F.col("doc_id").alias("y"), F.col("n_shingles").alias("ny"), F.col("rank").alias("ry"), F.col("component").alias("cy"))
    d = a.join(b, "key").where("cx <> cy AND (nx < ny OR nx = ny AND x < y)").where(_fits("nx", "ny")).where(_room("rx", "nx", "ry", "ny"))
    return d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _more(pairs: DataFrame, found: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Links and labels with those of further pairs."""
    more = stage(links(pairs, reps, docs, shingle), "more")
    if more.isEmpty():
        return found, labels
    found = found.union(more)
    return found, stage(components(found), "labels")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def prefixes(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """key, doc_id, n_shingles, rank: the rarest shingles of each document, so many that similar documents share one.

    Sets of similarity 0.8 share at least ceil(0.8 n) of the n elements of
    either, so in any common order of all elements the first n - ceil(0.8 n) + 1
    of both have one in common.  Rarest first, what very many documents share
    (a passage) comes last and makes no list unless it is most of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for at, end, part, offs in chunks(data, offsets):
                sets = list(shingle_sets(part, offs, shingle))
                n = np.array([len(x) for x in sets])
                row = pa.array(np.repeat(np.arange(at, end), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(row), pa.array(np.repeat(n, n))], ["key", "doc_id", "n_shingles"])

    every = _wanted(docs, ids).select("doc_id", "text").mapInArrow(run, "key long, doc_id long, n_shingles long")
    every = stage(every.dropDuplicates(["doc_id", "key"]), "shingles")
    often = every.groupBy("key").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("n", "key")
    ranked = every.join(often, "key").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank <= n_shingles - (4 * n_shingles + 4) div 5 + 1").select("key", "doc_id", "n_shingles", "rank")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM d, unnest(generate_series(1, greatest(1, len(w) - 3))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(other) AS m FROM r GROUP BY id) m USING (doc_id)
"""
