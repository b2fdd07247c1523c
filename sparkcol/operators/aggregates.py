"""Scalar, grouped, conditional and distinct aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(value: Column, scale: int | None = None) -> Column:
    """SUM in the type of the value. With ``scale``: a sum of doubles that doesn't depend on the order of rows, over decimals of so
    many places (and up to 28 digits in all); what is beyond these places is rounded off, so it is for money and the like."""
    return F.sum(value) if scale is None else F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def average(value: Column, scale: int | None = None) -> Column:
    """AVG; with ``scale`` of decimals, as in ``total``."""
    return F.avg(value) if scale is None else total(value, scale) / F.count(value)


def all_stats(df: DataFrame, column: str, scale: int | None = None) -> DataFrame:
    """Sum, count, min, max and mean in one pass; null without rows, count 0."""
    c = F.col(column)
    return df.agg(total(c, scale).alias("sum"), F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), average(c, scale).alias("avg"))


def minmax(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def count_nonnull(column: str, sentinel=None) -> Column:
    """Values that are neither null nor the ``sentinel``."""
    c = F.col(column)
    return F.count(c if sentinel is None else F.nullif(c, F.lit(sentinel)))


def count_nonzero(column: str) -> Column:
    return F.count_if(F.col(column) != 0)


def group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])


def dense_group(df: DataFrame, key: str, n_groups: int, value: str, scale: int | None = None) -> DataFrame:
    """Sum, count, min and max for each group 0..n_groups-1, groups without rows included; other keys are ignored."""
    spark = df.sparkSession
    summed = df.where(F.col(key).between(0, n_groups - 1)).groupBy(F.col(key).cast("long").alias("g")).agg(
        total(F.col(value), scale).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return spark.range(n_groups).withColumnRenamed("id", "g").join(summed, "g", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def conditional_sums(df: DataFrame, keys: Sequence[str], branches: Mapping[str, Column], value: Column, otherwise: str | None = None, scale: int | None = None) -> DataFrame:
    """Per group, the sum of ``value`` in each branch's rows; a row counts in the first branch that it meets, or in ``otherwise``."""
    taken, sums = F.lit(False), []
    for name, condition in branches.items():
        mine = F.coalesce(condition, F.lit(False)) & ~taken
        sums.append(total(F.when(mine, value).otherwise(0), scale).alias(name))
        taken = taken | F.coalesce(condition, F.lit(False))
    if otherwise:
        sums.append(total(F.when(~taken, value).otherwise(0), scale).alias(otherwise))
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def filter_sum_product(df: DataFrame, condition: Column, a: str, b: str, out: str = "total", scale: int | None = None) -> DataFrame:
    """SUM(a * b) over the rows that meet the condition, in one fused pass."""
    return df.where(condition).agg(total(F.col(a) * F.col(b), scale).alias(out))


def having(df: DataFrame, keys: Sequence[str], aggregate: Column, condition: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(aggregate.alias(out)).where(condition)


def two_phase(df: DataFrame, keys: Sequence[str], value: str, salts: int = 16, scale: int | None = None) -> DataFrame:
    """Group sums by way of salted partial groups: for keys so hot that one task's share of their rows is too much
    even after map-side combining, as with aggregates that keep much state."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    v = F.col(value) if scale is None else F.col(value).cast(f"decimal(28,{scale})")
    partial = salted.groupBy(*keys, "_salt").agg(F.sum(v).alias("_s"), F.count(value).alias("_n"))
    return partial.groupBy(*keys).agg((F.sum("_s") if scale is None else F.sum("_s").cast("double")).alias("sum"), F.sum("_n").alias("count"))


def rollup(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Groups by all keys, by all but the last, and so on to the whole; keys that a row isn't grouped by are null."""
    return df.rollup(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])


def cube(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Groups by every subset of the keys."""
    return df.cube(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, aggregate: Column) -> DataFrame:
    """``df`` with an aggregate over the rows of its group up to this one, in a total order."""
    return df.withColumn(out, aggregate.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str, offset: int = 1) -> DataFrame:
    """``df`` with the value of the row that stands ``offset`` before in its group (behind, if negative); null beyond its ends."""
    return df.withColumn(out, F.lag(column, offset).over(Window.partitionBy(*keys).orderBy(*order)))


def top_groups(df: DataFrame, keys: Sequence[str], aggregate: Column, n: int, out: str) -> DataFrame:
    """The ``n`` groups with the largest aggregate, ties by key: exact, unlike truncating partial groups."""
    return df.groupBy(*keys).agg(aggregate.alias(out)).orderBy(F.desc(out), *keys).limit(n)


def distinct_counts(df: DataFrame, keys: Sequence[str], column: str, out: str = "n_distinct") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(out)) if keys else df.agg(F.countDistinct(column).alias(out))


def approx_distinct(df: DataFrame, keys: Sequence[str], column: str, rsd: float = 0.02, out: str = "n_distinct") -> DataFrame:
    c = F.approx_count_distinct(column, rsd).alias(out)
    return df.groupBy(*keys).agg(c) if keys else df.agg(c)


def with_group_lookup(df: DataFrame, source: DataFrame, keys: Sequence[str], aggregate: Column, out: str) -> DataFrame:
    """``df`` with an aggregate of ``source`` for its key: a correlated scalar subquery as one aggregation and one join."""
    return df.join(source.groupBy(*keys).agg(aggregate.alias(out)), list(keys), "left")
