"""Checkpoints for operators that go over their data in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which driver and executors share.

    It is `spark.checkpoint.dir`; where that is unset, a local session gets a temporary one, and on a cluster it is an
    error, as executors don't see the driver's own folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandframe-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there: the plan doesn't grow, and executors may be lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
