"""What operators share: results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local master gets one of its own; a cluster raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sparkcol-checkpoint-"))
    return (configured or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that neither a second use nor a lost executor repeats it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
