"""Where checkpoints go, and how much goes to Python at once."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Where the session names none, a local master gets a temporary one; a
    cluster is an error, as its executors can't read a folder of the driver's machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Send at most ``rows`` rows and ``megabytes`` to Python at once where the session has Spark's defaults: texts are large rows."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", f"{64 << 20}b", f"{megabytes}m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
