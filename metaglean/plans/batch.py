"""The batch job: scan, remove, write, audit.  And the command line."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub
from ..functions.core import Options
from ..functions.textsql import output_path
from ..operators import files
from ..operators.audit import audit, exit_code
from ..sources import sinks, files as sources
from .options import Job, find_config, parse


def process(scanned: DataFrame, options: Options | None = None, output_dir: str | None = None, suffix: str = "-clean", in_place: bool = False, dry_run: bool = False) -> DataFrame:
    """Result rows of a scan: file, output_path, the cleaned content, sizes, removed kinds, success and error."""
    done = files.remove_metadata(scanned.select(F.col("path").alias("file"), "content"), options, dry_run=dry_run)
    target = output_path(F.col("file"), suffix, output_dir, in_place, F.col("format") if dry_run else F.col("output_format"))
    done = done.withColumn("success", F.col("error_class").isNull()).withColumn("dry_run", F.lit(dry_run)).withColumn("error", F.col("error_message"))
    return done.withColumn("output_path", F.when(F.col("success"), target))


#: Files that lose their output path to another, as far as they are sent to every task.
FEW_LOST = 100_000


def claimed(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``rows`` in which an output path belongs to one file only, that with the least name.

    The others fail and say which file has it.  ``before`` (file, output_path)
    holds what has been written already.  Contents move only if very many lose.
    """
    wanted = rows.where("success").select("file", "output_path")
    mine = wanted.groupBy("output_path").agg(F.min("file").alias("owner"))
    if before is not None:
        theirs = before.groupBy("output_path").agg(F.min("file").alias("earlier"))
        mine = mine.join(theirs, "output_path", "left").select("output_path", F.coalesce("earlier", "owner").alias("owner"))
    lost = wanted.join(mine, "output_path").where("owner <> file").select("file", "owner").distinct()
    rows = rows.join(F.broadcast(lost) if lost.count() <= FEW_LOST else lost, "file", "left")
    gone = F.col("owner").isNotNull()
    rows = rows.withColumn("error", F.when(gone, F.concat(F.lit("output path is that of "), "owner")).otherwise(F.col("error")))
    return rows.withColumn("success", F.col("success") & ~gone).withColumn("output_path", F.when(~gone, F.col("output_path"))).drop("owner")


def shown(df: DataFrame) -> None:
    """Prints every row of a report, a partition at a time."""
    for r in df.toLocalIterator(prefetchPartitions=True):
        print(*("" if x is None else x for x in r), sep="\t")


def run(spark: SparkSession, job: Job, results: str) -> DataFrame:
    """Runs a job; its result rows are written to ``results`` and returned."""
    folders, singles, broken = sources.classify(spark, list(job.inputs))
    for b in broken:
        print(f"can't be read: {b}", file=sys.stderr)
    scans = [sources.scan(spark, folders, job.recursive, job.include, job.exclude)] if folders else []
    scans += [sources.listed(spark, singles)] if singles else []
    if not scans:
        raise SystemExit(4)
    scanned = scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])
    rows = process(scanned, job.options, job.output_dir, job.suffix, job.in_place, job.dry_run)
    if not job.dry_run:
        rows.write.mode("overwrite").parquet(f"{results}/cleaned")
        rows = claimed(spark.read.parquet(f"{results}/cleaned"))
        written = sinks.write_files(rows.where("success"), source="file", skip_existing=job.skip_existing, backup_suffix=job.backup_suffix)
        written.write.mode("overwrite").parquet(f"{results}/written")
        w = spark.read.parquet(f"{results}/written").select(F.col("path").alias("output_path"), "written", F.col("error").alias("write_error"))
        rows = rows.join(w, "output_path", "left").withColumn("success", F.col("success") & F.col("write_error").isNull())
        rows = rows.withColumn("skipped_existing", F.col("success") & ~F.coalesce("written", F.lit(True))).withColumn("error", F.coalesce("error", "write_error"))
    return rows.drop("content")


def main(argv: list[str]) -> int:
    job = parse(argv, find_config())
    if job.inputs == ("-",):  # one file from standard input to standard output needs no cluster
        sys.stdout.buffer.write(scrub.remove(sys.stdin.buffer.read(), job.options).content)
        return 0
    spark = SparkSession.builder.appName("metaglean").getOrCreate()
    results = (job.report or "metaglean-report").rstrip("/")
    if job.watch:
        from ..streaming.watch import watch

        watch(spark, job, results).awaitTermination()
        return 0
    if job.inspect or job.stego:
        df = sources.scan(spark, list(job.inputs), job.recursive, job.include, job.exclude).select("path", "content")
        shown(files.steganography(df) if job.stego else files.read_metadata(df).select("path", files.inspect_text().alias("text")))
        return 0
    rows = run(spark, job, results)
    names = {"output_path": "output", "original_size": "original", "cleaned_size": "cleaned", "removed_metadata": "removed"}
    if not job.quiet:
        shown(sinks.print_entries(rows.withColumnsRenamed(names).orderBy("file"), job.print_as))
    totals = audit(rows)
    totals.write.mode("overwrite").json(f"{results}/audit")
    return totals.select(exit_code().alias("code")).first()["code"]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
