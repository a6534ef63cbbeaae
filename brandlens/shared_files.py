"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="brandlens-")


def new_shared_folder(spark: SparkSession) -> str:
    """A new folder's path under the shared one."""
    return f"{_shared_root(spark)}/{uuid.uuid4().hex}"


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
