"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregation to one minimum a node (combined before the shuffle), which is stored, and a
join of two plain shuffles by merging, so that adaptive execution can split the links of a hot node and
the driver builds no table to broadcast; no group is ever collected. The number of steps grows with the
logarithm of the longest chain. Only one row (a count and a checksum) comes to the driver after each pair
of steps. At most ``FEW`` links (a few MB) are joined in one task instead, with the same result.

Links with a null end or from a node to itself change nothing; repeated links count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewing.llm.common import settle

PER_TASK = 200_000
FEW = 1 << 19


def large_star(links: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = settle(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least")).coalesce(tasks))
    moved = both.filter("other > node").join(least.hint("merge"), "node").select(F.col("other").alias("high"), F.col("least").alias("low")).filter("high > low")
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def small_star(links: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = settle(links.groupBy("high").agg(F.min("low").alias("least")).coalesce(tasks))
    moved = links.join(least.hint("merge"), "high").filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).coalesce(tasks).distinct().coalesce(tasks)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, in order, and the smallest node that each is joined with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[up]
        x, y = x[open_], y[open_]
        np.minimum.at(up, high[open_], low[open_])
        while (deeper := up[up]).tobytes() != up.tobytes():
            up = deeper


def few_components(links: DataFrame) -> DataFrame:
    def run(batches):
        held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
        if held:
            nodes, root = roots(*(np.concatenate(x) for x in zip(*held)))
            moved = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["high", "low"])

    return links.select("high", "low").coalesce(1).mapInArrow(run, "high long, low long")


def components(links: DataFrame, a: str = "a", b: str = "b", few: int | None = None) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component. The tables
    between the steps have a task for every ``PER_TASK`` links: without that, a small link table would
    leave a file for each of the session's shuffle partitions at every step."""
    now = settle(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
    before = state(now)
    if before[0] <= (FEW if few is None else few):
        now = settle(few_components(now))
        before = (0,)
    while before[0]:
        tasks = 1 + before[0] // PER_TASK
        now = settle(small_star(settle(large_star(now.coalesce(tasks), tasks)), tasks))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
