"""Opt-in semantics that differ from standard SQL, as column helpers."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(value: Column | str) -> Column:
    """Case-folded text, for comparisons and group keys."""
    return F.lower(column(value))


def ci(op: str, left: Column | str, right: Column) -> Column:
    """A comparison (=, <>, <, <=, >, >=) of texts without regard to case."""
    named = {"=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    return named[op](fold(left), fold(right))


def trunc_div(left: Column | str, right: Column | str) -> Column:
    """Whole-number division that truncates and then becomes a double; a zero divisor gives null."""
    a, b = column(left), column(right)
    return F.try_divide(a - F.try_mod(a, b), b).cast("double")


def float_text(value: Column | str) -> Column:
    """The text of the value as a 32-bit float."""
    return column(value).cast("float").cast("string")


def logical_and(left: Column, right: Column) -> Column:
    return left & right


def logical_or(left: Column, right: Column) -> Column:
    return left | right


def logical_xor(left: Column, right: Column) -> Column:
    return left != right


def any_of_group(value: Column | str) -> Column:
    """Some value of the group, for a selected column that is not grouped; which one is not defined."""
    return F.any_value(column(value))


def date_parts(value: Column | str) -> list[Column]:
    c = column(value)
    return [F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day")]
