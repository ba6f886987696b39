"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``; a temporary one only where that is unset
    and the master is a single local process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="strataflow-lineage-")
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder, and without its lineage; a lost executor costs a re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
