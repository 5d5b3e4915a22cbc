"""Tables in the folder that all executors share, used to cut lineage.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only where that is unset
(local tests) a temporary folder is made and set. A table written here survives the loss of any
executor, and keeps its columns apart, so a later pass reads only those it needs.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_used: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = java.get() if java.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="thicket-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/thicket-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _used:
        atexit.register(release, spark)
    _used.add(path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and returns a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of `table` before the session ends; all that was made from it must be written."""
    _delete(df.sparkSession, df.scratch_path)
    _used.discard(df.scratch_path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, found by their exact names, whatever other columns are called."""
    at = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(at))))
    return flat.select(*(F.col(f"c{at.index(n)}").alias(n) for n in names))


def bound(value: Column, use) -> Column:
    """`use` of a variable that holds `value`, which is so computed once wherever it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def beside(df: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """All columns as c0, c1 and so on, these once more under their names, and what selects the
    input's columns again: helper columns can't clash with any."""
    at = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(at))))
    flat = flat.select("*", *(F.col(f"c{at.index(n)}").alias(n) for n in names))
    return flat, [F.col(f"c{i}").alias(n) for i, n in enumerate(at)]


def trim() -> None:
    """Gives freed memory back to the system; Python workers call it when a task or batch is done, as they
    idle beside other tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Deletes every table of this session; runs at exit too."""
    while _used:
        with contextlib.suppress(Exception):
            _delete(spark, _used.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it on its own path only."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)
