"""Shared folder, stage tables and worker code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
_SHIPPED: set[str] = set()
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a scale folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only where the
    setting is absent and all tasks run in the driver's own process (tests) a
    temporary folder stands in; elsewhere its absence is an error, for executors
    would each write to a disk of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.metaglean.shared", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
            base = "file://" + tempfile.mkdtemp(prefix="metaglean-")
            spark.conf.set("spark.metaglean.shared", base)
    return f"{base.rstrip('/')}/metaglean/{uuid.uuid4().hex}"


def write_stage(df: DataFrame, what: str, codec: str = "zstd") -> str:
    """Writes ``df`` to the shared folder; returns the path."""
    path = f"{shared_dir(df.sparkSession)}-{what}"
    df.write.option("compression", codec).parquet(path)
    forget_at_exit(df.sparkSession, path)
    return path


def stage(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: ``df`` written to the shared folder and read again.

    A later loss of an executor re-reads the table, never the work before it.
    """
    path = write_stage(df, what, codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver remove ``path`` when it ends, or the ``scratch`` around it before."""
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)
    made = _SCRATCH.get()
    if made is not None:
        made.append(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def drop_stage(staged: DataFrame) -> None:
    """Removes the table of ``stage`` when no later plan reads it."""
    remove(staged.sparkSession, staged.stage_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end what stages inside have written, but for paths taken off the list."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield made
    finally:
        _SCRATCH.reset(token)
        for path in made:
            remove(spark, path)


def trim(spark: SparkSession) -> None:
    """Has every executor collect its garbage and hand back the heap that it no longer fills.

    A heap that a heavy stage has grown stays as large for a while, beside the
    Python workers of the next one.  One task for each core reaches every
    executor that is there; those that come later have nothing to hand back.
    """
    n = spark.sparkContext.defaultParallelism
    gone = F.expr("reflect('java.lang.System', 'gc')").alias("gone")
    spark.range(0, n, 1, n).select(gone).write.format("noop").mode("overwrite").save()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Rows hold whole texts, so Arrow batches are made smaller than the default
    unless the session has a size of its own.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="metaglean-code-")
    name = os.path.join(folder, "metaglean_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(name)
    atexit.register(shutil.rmtree, folder, True)  # executors that start later fetch it too


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
