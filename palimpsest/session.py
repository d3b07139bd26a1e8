"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()

#: Rows that go to a Python worker at once, where the session has Spark's default: texts of some kilobytes are
#: a few megabytes so, and workers stay small beside the executor's heap.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS, SPARK_DEFAULT = "500", "10000"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors once an application, unless they are on PYTHONPATH already,
    and bounds the batches that Python workers get."""
    if spark.conf.get(BATCH, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app not in _shipped and str(ROOT) not in on_path:
        archive = f"{tempfile.mkdtemp(prefix='palimpsest-')}/palimpsest.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for p in sorted(ROOT.glob("palimpsest/**/*.py")):
                out.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all tasks
    run in this process. On a cluster it has to be set: a machine's own folder would not be seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
