"""File sources: folders, lists of paths, data URLs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textsql import parse_data_url, selected


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_length: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of the media files in folders.

    The path and length rules are plain filters: ``length`` is pushed into the
    scan, and a plan that does not use ``content`` never reads the files.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    df = df.where(selected(F.col("path"), include, exclude))
    return df if max_length is None else df.where(F.col("length") <= max_length)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of an explicit list, whatever their extension."""
    return spark.read.format("binaryFile").load(paths)


def stream(spark: SparkSession, folder: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), per_trigger: int = 1000) -> DataFrame:
    """New media files of a folder as a stream; each path once (the file source's log)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return df.where(selected(F.col("path"), include, exclude))


def from_data_urls(df: DataFrame, column: str, content: str = "content", error: str = "error_message") -> DataFrame:
    """Bytes of a column of data URLs; rows that are none have an error instead."""
    parsed = "parsed_"
    while parsed in {c.lower() for c in df.columns}:
        parsed += "_"
    return df.withColumn(parsed, parse_data_url(column)).withColumn(content, F.col(f"{parsed}.content")).withColumn(error, F.col(f"{parsed}.error")).drop(parsed)


def classify(spark: SparkSession, inputs: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Inputs split into folders, files and what can't be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders, files, broken = [], [], []
    for i in inputs:
        p = jvm.org.apache.hadoop.fs.Path(i)
        fs = p.getFileSystem(conf)
        (broken if not fs.exists(p) else folders if fs.getFileStatus(p).isDirectory() else files).append(i)
    return folders, files, broken
