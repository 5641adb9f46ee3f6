"""Corpora of media files made from the rows of the test tables by a rule.

The engine's queries read nothing of a corpus but (id, content).
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples
from ..functions.detect import detect
from .shipping import ship

#: Rows of a narrow table for each task that makes files of them.
SPREAD_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows in tasks of about SPREAD_ROWS: some MB of them are one split, so one task, however many files they become."""
    tasks = -(-df.count() // SPREAD_ROWS)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


_OTHERS = bytes(x for x in range(256) if x != 32 and not (x < 128 and chr(x).isalpha()))


def letters(text: bytes | None) -> str:
    """All ASCII letters and spaces of a text in UTF-8; x if there are none."""
    return (text or b"").translate(None, _OTHERS).strip(b" ").decode() or "x"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text in UTF-8."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))


#: The same rule in DuckDB SQL: k kind, b bits, s letters, f the same or its digest if a segment can't hold it, broken.
IMAGES = f"""(SELECT *, CASE WHEN length(s) > {samples.LONG} THEN md5(s) ELSE s END AS f FROM (SELECT doc_id AS id, doc_id % 7 AS k, doc_id % 11 AS b, doc_id % 17 = 5 AND doc_id % 7 < 4 AS broken,
    CASE WHEN coalesce(trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')), '') = '' THEN 'x' ELSE trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) END AS s FROM documents))"""


def made(df: DataFrame, f: Callable[..., bytes], kinds: Collection[str] | None = None) -> DataFrame:
    """id and content: ``f`` over the columns after the first; only files that are detected as one of ``kinds``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([f(*r) for r in rows], pa.binary())], ["id", "content"])
            yield out if kinds is None else out.filter(pa.array([detect(d) in kinds for d in out.column(1).to_pylist()], pa.bool_()))

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, "id long, content binary")


def images(spark: SparkSession, sf_dir: str, broken: bool = True, kinds: Collection[str] | None = None) -> DataFrame:
    """One of seven formats a document, with a subset of the metadata kinds; some are cut off."""
    cut = (F.col("doc_id") % 17 == 5) if broken else F.lit(False)
    d = texts(spark, sf_dir).select("doc_id", (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 11).cast("int"), "text", cut)
    return made(d, lambda k, b, t, cut: samples.image(k, b, letters(t), cut), kinds)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of eight brand rules, by part."""
    names = [("heic",), ("mif1",), ("avif",), ("qt  ",), ("isom",), ("M4V ",), ("zzzz", "mp42"), ("zzzz", "yyyy")]
    return made(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 8).cast("int")), lambda k: samples.ftyp(*names[k]) + b"\0" * 8)


def places(spark: SparkSession, sf_dir: str, kind: Column | None = None) -> DataFrame:
    """JPEG files (or PNG and WebP, by ``kind``) with coordinates from the events."""
    e = table(spark, sf_dir, "events")
    return made(spread(e.select("event_id", place()[0], place()[1], kind if kind is not None else F.lit(0))), lambda a, o, k: samples.located(a, o, kind=k))


def place() -> tuple[Column, Column]:
    lat = F.round((F.col("event_id") * 7919 % 180000) / 1000.0 - 90, 3)
    lon = F.round((F.col("event_id") * 104729 % 360000) / 1000.0 - 180, 3)
    return lat, lon


PLACES = "(SELECT event_id AS id, round((event_id * 7919 % 180000) / 1000.0 - 90, 3) AS lat, round((event_id * 104729 % 360000) / 1000.0 - 180, 3) AS lon FROM events)"


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies with text atoms from customers; every third one has a creation time."""
    c = table(spark, sf_dir, "customer")

    def f(k: int, name: str, segment: str) -> bytes:
        return samples.quicktime({"\xa9mak": name, "\xa9nam": segment} | ({"\xa9xyz": f"+{k % 80}.5-{k % 170}.25/"} if k % 2 else {}), 1000 if k % 3 == 0 else 0, "qt  " if k % 5 == 0 else "isom")

    return made(spread(c.select("c_custkey", F.col("c_custkey").cast("int"), "c_name", "c_mktsegment")), f)


def stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEIC files with EXIF items, and XMP items and colour boxes by rule."""
    s = table(spark, sf_dir, "part")

    def f(k: int, name: str) -> bytes:
        return samples.heic(samples.exif_block(name), b"<xmp/>" if k % 2 else b"", b"colour" if k % 3 == 0 else b"", k % 3)

    return made(spread(s.select("p_partkey", F.col("p_partkey").cast("int"), "p_name")), f)


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages wrapped as SVG documents."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.encode(F.concat(F.lit("<svg>"), "html", F.lit("</svg>")), "utf-8").alias("content"))


DRAWINGS = "(SELECT page_id AS id, '<svg>' || html || '</svg>' AS t FROM pages)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of a batch, by rule, from line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("f"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("file"), F.col("l_shipmode").alias("mode") if "l_shipmode" in li.columns else F.col("l_returnflag").alias("mode"),
        (F.col("l_quantity") <= 40).alias("success"), (F.col("l_linenumber") == 1).alias("dry_run"), (F.col("l_linenumber") == 2).alias("skipped_existing"),
        F.when(F.col("l_quantity") <= 45, F.col("l_extendedprice").cast("long")).alias("original_size"), F.when(F.col("l_quantity") <= 40, (F.col("l_extendedprice") * 0.5).cast("long")).alias("cleaned_size"),
    )


RESULTS = """(SELECT 'f' || l_orderkey || '_' || l_linenumber AS file, l_returnflag AS mode, l_quantity <= 40 AS success, l_linenumber = 1 AS dry_run, l_linenumber = 2 AS skipped_existing,
    CASE WHEN l_quantity <= 45 THEN CAST(trunc(l_extendedprice) AS BIGINT) END AS original_size, CASE WHEN l_quantity <= 40 THEN CAST(trunc(l_extendedprice * 0.5) AS BIGINT) END AS cleaned_size FROM lineitem)"""
