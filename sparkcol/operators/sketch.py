"""Multi-resolution time buckets: count, sum, sum of squares, min and max, from which mean and variance follow.

Buckets of one level merge into those of the next, so only the finest level reads the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Level -> (seconds of a bucket, buckets kept). Fixed values of the data model.
LEVELS = {0: (1, 3600), 1: (60, 1440), 2: (3600, 168), 3: (86400, 365)}


def bucket_start(at: Column, seconds: int) -> Column:
    """Epoch seconds at which the bucket of a time begins."""
    return (F.floor(F.unix_seconds(at.cast("timestamp")) / seconds) * seconds).cast("long")


def statistics(value: str, scale: int | None) -> list[Column]:
    """The columns of a bucket. ``scale``: sums over decimals of so many places, which don't depend on the order of rows; else of the type."""
    v = F.col(value) if scale is None else F.col(value).cast(f"decimal(18,{scale})")
    square = v.cast("double") * v.cast("double") if scale is None else (v * v).cast(f"decimal(36,{2 * scale})")
    return [F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(square).alias("squares"), F.min(value).alias("low"), F.max(value).alias("high")]


def buckets(events: DataFrame, level: int, at: str = "ts", value: str = "value", keys: tuple[str, ...] = (), scale: int | None = None) -> DataFrame:
    start = bucket_start(F.col(at), LEVELS[level][0]).alias("bucket")
    return events.where(F.col(value).isNotNull()).groupBy(*keys, start).agg(*statistics(value, scale))


def merge(finer: DataFrame, level: int, keys: tuple[str, ...] = ()) -> DataFrame:
    seconds = LEVELS[level][0]
    start = (F.floor(F.col("bucket") / seconds) * seconds).cast("long").alias("bucket")
    return finer.groupBy(*keys, start).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def finished(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """With avg, variance (of the population; 0 for fewer than two values) and stddev."""
    n, total, squares = F.col("n"), F.col("total").cast("double"), F.col("squares").cast("double")
    variance = F.when(n < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))
    return found.select(*keys, "bucket", "n", F.round(total, 4).alias("total"), "low", "high", F.round(total / n, 4).alias("avg"), F.round(variance, 4).alias("variance"), F.round(F.sqrt(variance), 4).alias("stddev"))


def retained(found: DataFrame, level: int) -> DataFrame:
    """The newest buckets that a level keeps."""
    seconds, kept = LEVELS[level]
    last = found.agg(F.max("bucket").alias("_last"))
    return found.crossJoin(F.broadcast(last)).where(F.col("bucket") > F.col("_last") - seconds * kept).drop("_last")


def recent(found: DataFrame, now: int, window: int) -> DataFrame:
    """One row over the buckets that begin in the ``window`` seconds before ``now`` (epoch seconds)."""
    return found.where((F.col("bucket") > now - window) & (F.col("bucket") <= now)).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.round(F.sum("total").cast("double"), 4).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )
