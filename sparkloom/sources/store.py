"""The shared folder, for checkpoints and what a job writes for itself."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint(spark: SparkSession) -> None:
    """Sets a checkpoint folder of its own in a local session that names none; a cluster must name one that all machines see."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    ensure_checkpoint(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
