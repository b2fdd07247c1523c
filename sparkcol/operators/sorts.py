"""Sorts, argsorts and top-k, always with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def order(column: str, descending: bool = False) -> Column:
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def sort(df: DataFrame, by: Sequence[tuple[str, bool]], ties: Sequence[str] = ()) -> DataFrame:
    """``by``: (column, descending). Nulls come last either way; ``ties`` make the order total."""
    return df.orderBy(*[order(c, d) for c, d in by], *ties)


def top_k(df: DataFrame, by: Sequence[tuple[str, bool]], k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows, min(k, n) of them: each task keeps k, no full sort."""
    return sort(df, by, ties).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[tuple[str, bool]], k: int, ties: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows per group before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*[order(c, d) for c, d in by], *ties)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def argsort(df: DataFrame, column: str, row_id: str, descending: bool = False, out: str = "position") -> DataFrame:
    """The row ids in the order of ``column``, with their places from 0: a range exchange, a count per partition and no
    single-task window."""
    name = "_partition"
    placed = df.select(row_id, column).orderBy(order(column, descending), row_id).withColumns({name: F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    placed = written(placed.withColumn("_m", F.col("_m").bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy(name).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return placed.join(F.broadcast(starts.select(name, "_start")), name).select(row_id, column, (F.col("_start") + F.col("_m")).alias(out))


def merge_sorted(frames: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(*by)
