"""A session with the settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app_name: str = "sparkcol", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and runtime join filters on, in UTC.

    On a cluster leave ``master`` to spark-submit and ``shuffle_partitions`` to adaptive coalescing from a generous start.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.codegen.cache.maxEntries": "2000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k: str(v) for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()
