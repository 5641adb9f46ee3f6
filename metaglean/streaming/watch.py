"""Incremental removal: new files of a folder, each processed once.

No keyed state is needed; the file source's log gives each path once, and the
sink writes by path, so a repeated batch leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.core import Options
from ..operators import files
from ..plans.batch import claimed, process
from ..plans.options import Job
from ..sources import files as sources, sinks


class Progress(StreamingQueryListener):
    """Calls back with the rows so far after each batch of a stream."""

    def __init__(self, callback: Callable[[int, int], None]):
        self.callback, self.rows = callback, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.callback(event.progress.batchId, self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def scrub_stream(df: DataFrame, options: Options | None = None) -> DataFrame:
    """The removal over a stream (or a table) of files: one row in, one row out."""
    return files.remove_metadata(df, options)


def watch(spark: SparkSession, job: Job, results: str, once: bool = False) -> StreamingQuery:
    """Writes cleaned files and result rows as files arrive in any of the inputs; ``once`` stops when all present ones are done.

    A file whose output path an earlier one has is not written; the row of its write says so.
    """
    if not job.output_dir or any(job.output_dir.rstrip("/").startswith(i.rstrip("/")) for i in job.inputs):
        raise ValueError("the output folder has to lie outside of the watched folder")

    folders = [i.rstrip("/") for i in job.inputs]
    folders = sorted({i for i in folders if not any(i.startswith(j + "/") for j in folders)})

    def each(batch: DataFrame, number: int) -> None:
        rows = process(batch, job.options, job.output_dir, job.suffix)
        path = f"{results}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        earlier = batch.sparkSession.read.parquet(results).where(F.col("batch") != number).where("success").select("file", "output_path")
        done = claimed(batch.sparkSession.read.parquet(path), earlier)
        lost = done.where("not success").select(F.lit(None).cast("string").alias("path"), F.lit(False).alias("written"), F.concat_ws(": ", "file", "error").alias("error"))
        sinks.write_files(done.where("success"), source="file").unionByName(lost).write.mode("overwrite").parquet(f"{results}-written/batch={number}")

    df = reduce(DataFrame.unionByName, [sources.stream(spark, i, job.include, job.exclude) for i in folders])
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", f"{results}-checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
