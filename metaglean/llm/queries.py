"""The contract queries of the ten operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary file: a setting of the session, else the public file of this machine."""
    path = spark.conf.get("spark.metaglean.tokenizer", None)
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import without_earlier

    out = without_earlier(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, labels)).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import joined, scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.expr(f"cast(size(filter(base_spans, x -> x.k = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return out.select("doc_id", *n, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    out = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, tokenizer_path(spark)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import joined, scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(("email", "ip", "card", "phone"))]
    return out.select("doc_id", *n, F.sha2(joined("spans", 4), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, near_dedup, quality_rules, suffix_dedup, warc

    sources = {"op1_quality_rules": quality_rules, "op2_suffix_dedup": suffix_dedup, "op6_warc": warc, "op9_decontaminate": decontaminate, "op10_near_dedup": near_dedup}
    return {name: module.ORACLE for name, module in sources.items()}
