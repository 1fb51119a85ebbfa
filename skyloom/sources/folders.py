"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, prefix: str = "skyloom") -> str:
    """A new folder under spark.checkpoint.dir; where that is unset in local mode, under a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("skyloom.local.shared", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("skyloom.local.shared", base)
    if "://" not in base:
        base = f"file://{base}" if base.startswith("/") else base.replace("file:/", "file:///", 1)
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder: the session's own, where it names one."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()
