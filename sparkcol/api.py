"""The short names of the library: filters, counts, groups, joins and top-k on one column."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import aggregates, filters, joins, sorts


def _filter(op: str, df: DataFrame, column: str, value) -> DataFrame:
    return df.where(filters.compare(column, op, value))


def _count(op: str, df: DataFrame, column: str, value) -> DataFrame:
    return filters.count_where(df, filters.compare(column, op, value))


filter_eq, filter_ne, filter_lt, filter_le, filter_gt, filter_ge = (partial(_filter, op) for op in ("eq", "ne", "lt", "le", "gt", "ge"))
count_eq, count_ne, count_lt, count_le, count_gt, count_ge = (partial(_count, op) for op in ("eq", "ne", "lt", "le", "gt", "ge"))


def group_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    return aggregates.group(df, [key], total=F.sum(value))


def group_count(df: DataFrame, key: str) -> DataFrame:
    return aggregates.group(df, [key], n=F.count("*"))


def inner_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    return joins.join(probe, build, [(probe_key, build_key)])


def semi_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    return joins.join(probe, build, [(probe_key, build_key)], "semi")


def anti_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    return joins.join(probe, build, [(probe_key, build_key)], "anti")


def topk(df: DataFrame, column: str, k: int, ties: list[str] | None = None, largest: bool = True) -> DataFrame:
    return sorts.top_k(df, [(column, largest)], k, ties or [])
