"""Audit reports over result rows: plain aggregates, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("total_files", "successful", "failed", "skipped", "skipped_existing", "original_bytes", "cleaned_bytes", "bytes_removed")


def audit(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of success, dry_run, skipped_existing, original_size and cleaned_size (absent ones count as none)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in entries.columns else F.lit(False)
    size = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long")
    original, cleaned = size("original_size"), size("cleaned_size")
    totals = [
        F.count("*").alias("total_files"), F.count_if(flag("success")).alias("successful"), F.count_if(~flag("success")).alias("failed"),
        F.count_if(flag("success") & flag("dry_run")).alias("skipped"), F.count_if(flag("skipped_existing")).alias("skipped_existing"),
        original.alias("original_bytes"), cleaned.alias("cleaned_bytes"), (original - cleaned).alias("bytes_removed"),
    ]
    return entries.groupBy(*(by or [])).agg(*totals)


def merged(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the totals of several reports."""
    return reports.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))


def split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful and failed entries."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return entries.where(ok), entries.where(~ok)


def exit_code(total: str = "total_files", failed: str = "failed") -> Column:
    """0 if all succeeded, 1 if some failed, 2 if all did, 4 without input."""
    return F.when(F.col(total) == 0, 4).when(F.col(failed) == 0, 0).when(F.col(failed) == F.col(total), 2).otherwise(1)


def report(entries: DataFrame) -> DataFrame:
    """One row: the time of the report and the totals."""
    return audit(entries).withColumn("timestamp", F.current_timestamp())
