"""Scalar functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED_POINT = 10_000


def substring(c: Column, start: int, length: int) -> Column:
    """1-based, as SQL has it: positions before the first character count but hold nothing."""
    if start < 1:
        start, length = 1, max(0, length + start - 1)
    return F.substring(c, start, length)


def prefix_number(c: Column, length: int) -> Column:
    """The first ``length`` characters as a number; -1 if there are fewer or one of them is no digit."""
    head = F.substring(c, 1, length)
    return F.coalesce(F.when(head.rlike(f"^[0-9]{{{length}}}$"), head.cast("int")), F.lit(-1))


def epoch_days(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def from_epoch_days(c: Column) -> Column:
    return F.date_from_unix_date(c)


def year(c: Column) -> Column:
    return F.year(c).cast("int")


def to_fixed(c: Column) -> Column:
    """A number as an integer of ten-thousandths, rounded half away from zero."""
    return F.round(c.cast("decimal(18,6)") * FIXED_POINT, 0).cast("long")


def fixed_mul(a: Column, b: Column) -> Column:
    """The product of two fixed-point numbers, truncated."""
    product = a.cast("decimal(20,0)") * b.cast("decimal(18,0)")
    return F.when(product >= 0, F.floor(product / FIXED_POINT)).otherwise(F.ceil(product / FIXED_POINT)).cast("long")


def fixed_div(a: Column, b: Column) -> Column:
    """The quotient of two fixed-point numbers, truncated; null for a divisor of 0."""
    return F.call_function("div", a * FIXED_POINT, F.nullif(b, F.lit(0)))


def from_fixed(c: Column) -> Column:
    return (c / FIXED_POINT).cast("double")


def discounted(price: Column, discount: Column) -> Column:
    return price * (1 - discount)


def charged(price: Column, discount: Column, tax: Column) -> Column:
    return discounted(price, discount) * (1 + tax)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
