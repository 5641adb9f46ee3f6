"""Sends this package to the Python workers, once per application.

A row holds a whole file, so Arrow batches are kept short unless the session
has a size of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "256"
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="metaglean-lib-")
    name = os.path.join(folder, "metaglean_lib.zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in (x for x in files if x.endswith(".py")):
                full = os.path.join(at, f)
                z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(name)
    atexit.register(shutil.rmtree, folder, True)
