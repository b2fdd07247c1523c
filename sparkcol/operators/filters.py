"""Filters and predicates as Column expressions, so that Catalyst can push them into scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
}


def compare(column: str, op: str, value: Any) -> Column:
    """``column op value`` with op one of eq, ne, lt, le, gt, ge; null compares to nothing."""
    return COMPARE[op](F.col(column), value)


def in_range(column: str, low: Any, high: Any) -> Column:
    """low <= column < high."""
    return (F.col(column) >= low) & (F.col(column) < high)


def between(column: str, low: Any, high: Any) -> Column:
    """low <= column <= high."""
    return F.col(column).between(low, high)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def any_group(groups: Iterable[Iterable[Column]]) -> Column:
    """A disjunction of conjunctions."""
    return any_of(all_of(g) for g in groups)


def text_match(column: str, kind: str, value: Any) -> Column:
    """equals, not_equals, prefix, suffix, contains, like, not_like, in, not_in, contains_in_order."""
    c = F.col(column)
    if kind == "contains_in_order":
        return c.like("%" + "%".join(value) + "%")
    return {
        "equals": lambda: c == value,
        "not_equals": lambda: c != value,
        "prefix": lambda: c.startswith(value),
        "suffix": lambda: c.endswith(value),
        "contains": lambda: c.contains(value),
        "like": lambda: c.like(value),
        "not_like": lambda: ~c.like(value),
        "in": lambda: c.isin(list(value)),
        "not_in": lambda: ~c.isin(list(value)),
    }[kind]()


def select_where(df: DataFrame, condition: Column, columns: Sequence[str] = ()) -> DataFrame:
    found = df.where(condition)
    return found.select(*columns) if columns else found


def count_where(df: DataFrame, condition: Column, out: str = "n") -> DataFrame:
    return df.agg(F.count_if(condition).alias(out))


def with_mask(df: DataFrame, condition: Column, out: str = "mask") -> DataFrame:
    """A flag per row instead of a filter; null conditions are false."""
    return df.withColumn(out, F.coalesce(condition, F.lit(False)))


def masks_combined(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of rows in either mask, in both and in any."""
    return df.agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_and"), F.count_if(a | b).alias("n_or"))


def set_index(column: str, members: Sequence[Any]) -> Column:
    """1-based place of the value in ``members``; 0 if it has none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(m) for m in members]), F.col(column)), F.lit(0)).cast("int")
