"""Cutting a plan's lineage in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read from there.

    The folder is that of ``spark.checkpoint.dir``; only with a local master, where that is unset, a
    temporary one is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="tarnflow-")
            atexit.register(shutil.rmtree, at, True)
        context.setCheckpointDir(at)
    return df.checkpoint()
