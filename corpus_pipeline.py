"""Corpus pipeline: quality rules, near-dedup, decontamination, secret scans, BPE.

Each stage works on all rows that its predecessor kept, and the written result
of a stage is the input of the next.  Stages that filter keep or drop whole
documents by their ids (rows of one id share one verdict: they stay only if the
verdict of all of them is to stay); the secret stage replaces secrets in the
texts; the last one adds token counts and digests.  Stages whose Python workers
or heaps grow begin with executors that have handed back their free heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaglean.llm.bpe import digests
from metaglean.llm.common import drop_stage, fresh_name, scratch, stage, table, trim
from metaglean.llm.decontaminate import contamination
from metaglean.llm.near_dedup import near_duplicates
from metaglean.llm.quality_rules import judge, measure, references
from metaglean.llm.queries import tokenizer_path
from metaglean.llm.secret_scan import redact

#: SQL cannot express the BPE stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
#: Ids that several rows have, as far as they are sent to every task.
REPEATED_IDS = 100_000


def _same(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not in the column doc_id of ``gone``."""
    ids = gone.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["gone_id"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go."""
    m = fresh_name(docs.columns, "measures")
    measured = stage(measure(docs, into=m), "measured")
    return _same(judge(measured, references(measured, m=m), m, m).where(f"{m}kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles) the document with the smallest id stays, once."""
    trim(spark)
    gone = near_duplicates(docs, shingle=5).where("not kept")
    left = _without(docs, gone)
    # Whole rows are compared, and moved, only where an id occurs again.
    twice = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return _same(left, docs.columns)
    few = twice.select(F.col("doc_id").alias("again_id"))
    again = F.broadcast(few) if few.count() <= REPEATED_IDS else few
    same = left["doc_id"].eqNullSafe(again["again_id"])
    once = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return _same(once, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of full length go, however long they are, and those of which 5% is in any windows.

    A shorter item, which may be a common word, counts by its share only.
    """
    trim(spark)
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("whole or contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars follows."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return _same(out, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the number of tokens and the digests of an encode-decode round trip."""
    trim(spark)
    return digests(docs, tokenizer_path(spark))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secrets), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again.

    What a stage has written on its way, and the result before it, are removed
    when its own result is there.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        with scratch(spark) as made:
            docs = stage(f(spark, docs, sf_dir), name)
            made.remove(docs.stage_path)
        if before is not None:
            drop_stage(before)
        before = docs
    return docs
