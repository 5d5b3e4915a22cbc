"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`. Only a local session may do without: a folder of
    one machine would be lost to all others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_before.get() if set_before.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="thicket-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it on its own path only."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)


def cut(df: DataFrame) -> DataFrame:
    """Computes `df` now and keeps it in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
