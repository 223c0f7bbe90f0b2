"""The operators over DataFrames: thin, declarative, left to Catalyst and adaptive execution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewing.sources.index import plan_bytes

BROADCAST_BYTES = 64 << 20


def project(df: DataFrame, *items: Column | str, **named: Column) -> DataFrame:
    """Select items, then computed columns under a name."""
    return df.select(*items, *[c.alias(n) for n, c in named.items()])


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions."""
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def join(left: DataFrame, right: DataFrame, *conditions: Column) -> DataFrame:
    """Inner join on any conditions: equalities become hash or merge joins, others nested loops. Without
    a condition it is the Cartesian product."""
    return left.join(right, reduce(lambda a, b: a & b, conditions), "inner") if conditions else left.crossJoin(right)


def join_all(first: DataFrame, *steps: tuple[DataFrame, Column]) -> DataFrame:
    """Left-deep chain of inner joins, which Catalyst may reorder."""
    return reduce(lambda df, step: df.join(step[0], step[1], "inner"), steps, first)


def join_lookup(left: DataFrame, right: DataFrame, condition: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join that looks rows up in ``right``: as a broadcast table if the optimizer's estimate of it is at
    most ``most`` bytes, else as an ordinary join."""
    return left.join(F.broadcast(right) if plan_bytes(right) <= most else right, condition, "inner")


def aggregate(df: DataFrame, *keys: Column | str, any_of: tuple[str, ...] = (), **measures: Column) -> DataFrame:
    """Grouped, or global without keys (then one row, even for no input). ``any_of`` are selected
    columns that are not grouped: each gives some value of its group."""
    aggs = [F.any_value(c).alias(c) for c in any_of] + [m.alias(n) for n, m in measures.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    """The first n rows in an order, without a full sort."""
    return df.orderBy(*keys).limit(n)
