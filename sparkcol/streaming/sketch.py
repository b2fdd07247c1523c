"""The time buckets as a stream: watermarked windows over an arriving table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sketch import statistics


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, seconds: int, at: str = "ts", value: str = "value", keys: tuple[str, ...] = (), late: str = "1 hour", scale: int | None = None) -> DataFrame:
    """Buckets of a stream (or table) of events; what is later than the watermark is dropped, state stays bounded."""
    stream = events.where(F.col(value).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        stream = stream.withWatermark("_at", late)
    found = stream.groupBy(*keys, F.window("_at", f"{seconds} seconds").alias("w")).agg(*statistics(value, scale))
    return found.select(*keys, F.unix_seconds(F.col("w.start")).alias("bucket"), "n", "total", "squares", "low", "high")


def run_available(found: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Process what is there, and return the buckets as they stand, read from the folder that they were written to.

    Each batch writes the buckets that it changed, with its number, and overwrites what an earlier try of it left; of a bucket
    the version of the latest batch counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    found.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark, columns = found.sparkSession, found.columns
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], found.schema)
    versions = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.schema.fields)}, batch long").parquet(path)
    latest = versions.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return latest.select("s.*")


def run_to_parquet(found: DataFrame, path: str, checkpoint: str) -> None:
    """Append buckets that the watermark has passed to a folder, once each."""
    query = found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
