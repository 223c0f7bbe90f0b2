"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Unit vectors are projected to ``dims`` Gaussian (2-stable) coordinates: the squared projected distance
over the squared true distance follows a chi-square law with ``dims`` degrees of freedom. The projections
are indexed by a kd-tree: its top, whose planes are fitted to a bounded sample of ``SAMPLE`` projections,
deals all rows to cells of about ``VALUES`` numbers; below, each cell (split into blocks by a salt if it
is much larger, such as one with a very frequent vector) has a kd-tree of its own, whose leaves hold the
vectors. For a query the leaves come in the order of their projected distance; the vectors of each are
verified by their exact cosine, and the search stops when chi_square(next projected distance^2 / k-th
best true distance^2) reaches ``surety``: a nearer vector would by then have been seen with that
probability.

A query first searches its own cell, and then only the cells whose bounding boxes the same test leaves
open. Queries and rows meet in their cells by one shuffle each; no query set is broadcast or collected,
and only the cells' boxes (one row for each ``VALUES`` numbers of the table) are sent to all tasks.
``n_blocks`` says in how many blocks a query has searched.

Every row is indexed and searched for. Defined results: vectors that are null, empty, zero, or hold a
null or non-finite component take no part; vectors of different lengths are not compared; rows with the
query's own id are not its candidates; a query row that is repeated is asked once, candidate rows that
are repeated are several candidates; ties go to the smaller id; fewer candidates give fewer rows; an
empty table gives none.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.llm.common import settle, stored, table

PROJECTED = 8
LEAF = 128
SAMPLE = 1 << 14
VALUES = 1 << 19


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    if x <= 0:
        return 0.0
    if x > 700:
        return 1.0
    term = total = math.exp(-x / 2)
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 700.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


def projection(size: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + size).standard_normal((size, dims))


class KdTree:
    """Median splits on the widest coordinate; leaves are runs of rows with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self.points = points
        self.root = self.build(0, len(points), leaf)

    def build(self, lo: int, hi: int, leaf: int) -> int:
        rows = self.points[self.order[lo:hi]]
        low, high = rows.min(axis=0), rows.max(axis=0)
        children = None
        axis = int(np.argmax(high - low))
        if hi - lo > leaf and high[axis] > low[axis]:
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], mid)]
            children = self.build(lo, lo + mid, leaf), self.build(lo + mid, hi, leaf)
        self.nodes.append((low, high, lo, hi, children))
        return len(self.nodes) - 1

    def leaves(self, point: np.ndarray):
        """(squared distance to the box, first row, end) of the leaves, nearest first, as asked for."""
        heap = [(0.0, self.root)]
        while heap:
            d, k = heapq.heappop(heap)
            _, _, lo, hi, children = self.nodes[k]
            if children is None:
                yield d, lo, hi
                continue
            for c in children:
                low, high = self.nodes[c][:2]
                gap = np.maximum(np.maximum(low - point, point - high), 0)
                heapq.heappush(heap, (float(gap @ gap), c))


def search(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, query, point, query_id, k: int, limit: float, least: float = -2.0):
    """The k best (score, id) of a block, none worse than ``least``; ``limit`` is the chi-square quantile
    of the surety. vectors, norms and ids are in the tree's order."""
    size = math.sqrt(float((query * query).sum()))
    best_scores, best_ids = np.zeros(0), np.zeros(0, np.int64)
    for gap, lo, hi in tree.leaves(point):
        worst = max(least, best_scores[-1]) if len(best_scores) == k else least
        if worst >= -1 and shut(gap, worst, limit):
            break
        scores = (vectors[lo:hi] * query).sum(axis=1) / (norms[lo:hi] * size)
        use = (ids[lo:hi] != query_id) & (scores >= worst)
        if use.any():
            best_scores, best_ids = np.r_[best_scores, scores[use]], np.r_[best_ids, ids[lo:hi][use]]
            top = np.lexsort((best_ids, -best_scores))[:k]
            best_scores, best_ids = best_scores[top], best_ids[top]
    return best_scores, best_ids


def shut(gap, score, limit: float):
    """Whether the stopping test holds for a squared projected distance and a k-th best cosine."""
    return (gap > 1e-18) & (gap >= limit * np.maximum(0.0, 2 - 2 * score))


class Top:
    """The planes of the top of the tree, fitted to a sample; cells are numbered from the left."""

    def __init__(self, points: np.ndarray, cells: int):
        self.cells = 0
        self.root = self.build(points, cells)

    def build(self, points: np.ndarray, cells: int):
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) > 1 else 0
        if cells > 1 and len(points) > 1 and np.ptp(points[:, axis]) > 0:
            left = cells // 2
            order = np.sort(points[:, axis])
            at = order[min(len(order) - 1, len(order) * left // cells)]
            low = points[:, axis] < at if at > order[0] else points[:, axis] <= at
            plane = float(at) if at > order[0] else float(np.nextafter(at, np.inf))
            return axis, plane, self.build(points[low], left), self.build(points[~low], cells - left)
        self.cells += 1
        return self.cells - 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def go(node, rows):
            if isinstance(node, int):
                out[rows] = node
            else:
                axis, plane, left, right = node
                low = points[rows, axis] < plane
                go(left, rows[low])
                go(right, rows[~low])

        go(self.root, np.arange(len(points)))
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, n): the rows that take part, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~odd & F.exists("v", lambda x: x != 0))


def projected(matrix: np.ndarray, dims: int, seed: int) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) @ projection(matrix.shape[1], dims, seed)


def by_length(batch: pa.RecordBatch, column: int):
    """The row numbers of each vector length, and their matrix."""
    lists = batch.column(column)
    flat, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        yield int(n), own, flat[starts[own][:, None] + np.arange(n)]


def sampled(rows: DataFrame, dims: int, seed: int) -> dict[int, np.ndarray]:
    """Projections of a bounded sample, the first rows by a hash, for each vector length."""

    def run(batches):
        for batch in batches:
            for n, _, matrix in by_length(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(matrix), n), pa.int64()), pa.array([x.tobytes() for x in projected(matrix, dims, seed)], pa.binary())], names=["n", "p"])

    first = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v")
    got: dict[int, list] = {}
    for n, p in first.mapInArrow(run, "n long, p binary").collect():
        got.setdefault(n, []).append(np.frombuffer(p))
    return {n: np.stack(x) for n, x in got.items()}


def placed(rows: DataFrame, dims: int, seed: int, values: int) -> DataFrame:
    """(vec_id, v, n, cell, p) of all rows: vector length, number of the cell, projection."""
    sample, sizes = sampled(rows, dims, seed), dict(rows.groupBy(F.size("v")).agg(F.count(F.lit(1))).collect())
    tops = {n: Top(points, max(1, math.ceil(sizes.get(n, 0) * n / values))) for n, points in sample.items()}
    shared = rows.sparkSession.sparkContext.broadcast(tops)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, points, lengths = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, dims)), np.zeros(batch.num_rows, np.int32)
            for n, own, matrix in by_length(batch, 1):
                points[own], lengths[own] = projected(matrix, dims, seed), n
                if n in shared.value:
                    cells[own] = shared.value[n].assign(points[own])
            p = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, dims), pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lengths), pa.array(cells), p], names=["vec_id", "v", "n", "cell", "p"])

    return stored(rows.mapInArrow(run, "vec_id long, v array<double>, n int, cell int, p array<double>"), "placed")


def searched(rows: DataFrame, asked: DataFrame, k: int, limit: float, dims: int, seed: int) -> DataFrame:
    """(qkey, query_id, vec_id, score) of the k best of every block that is asked. rows: (n, cell, salt,
    vec_id, v); asked: (n, cell, salt, qkey, query_id, least, v). Rows and then queries of a block stream
    by, so a task holds one block."""
    none = F.lit(None).cast("long")
    both = rows.select("n", "cell", "salt", none.alias("qkey"), "vec_id", F.lit(None).cast("double").alias("least"), "v").unionByName(
        asked.select("n", "cell", "salt", "qkey", F.col("query_id").alias("vec_id"), "least", "v")
    )

    def run(batches):
        current, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            query = np.asarray(batch.column(3).is_valid())
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (query[1:] != query[:-1])])
            out = []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                if current != (now := tuple(key[:, a])):
                    current, held, tree = now, [], None
                part = batch.slice(a, b - a)
                ids, matrix = np.asarray(part.column(4)), next(by_length(part, 6))[2]
                if not query[a]:
                    held.append((ids, matrix))
                    continue
                if not held:
                    continue
                if tree is None:
                    own_ids, own = (np.concatenate(x) for x in zip(*held))
                    norms = np.sqrt((own * own).sum(axis=1))
                    tree = KdTree(projected(own, dims, seed))
                    held, own_ids, own, norms = held[:1], own_ids[tree.order], own[tree.order], norms[tree.order]
                for q, i, least, v, p in zip(part.column(3).to_pylist(), ids.tolist(), np.asarray(part.column(5)), matrix, projected(matrix, dims, seed)):
                    scores, near = search(tree, own_ids, own, norms, v, p, i, k, limit, least)
                    out.append((np.full(len(near), q), np.full(len(near), i), near, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["qkey", "query_id", "vec_id", "score"])

    dealt = both.repartition("n", "cell", "salt").sortWithinPartitions("n", "cell", "salt", F.col("qkey").isNotNull(), "qkey")
    return dealt.mapInArrow(run, "qkey long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", surety: float = 0.95, dims: int = PROJECTED, seed: int = 7, values: int = VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score, n_blocks) of every row for which ``is_query`` (a condition on
    vec_id) holds."""
    limit = quantile(surety, dims)
    every = placed(usable(vectors, id_col, vector_col), dims, seed, values)
    box = [f(F.col("p")[i]) for f in (F.min, F.max) for i in range(dims)]
    boxes: dict[int, list] = {}
    for n, cell, count, *box_of in every.groupBy("n", "cell").agg(F.count(F.lit(1)), *box).collect():
        boxes.setdefault(n, []).append((cell, math.ceil(count * n / (2 * values)), box_of))
    shared = vectors.sparkSession.sparkContext.broadcast({n: (np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own])) for n, own in boxes.items()})
    salts = [(n, cell, salt) for n, own in boxes.items() for cell, salt, _ in own if salt > 1]
    hot = vectors.sparkSession.createDataFrame(salts, "n int, cell int, salts int")
    rows = every.join(F.broadcast(hot), ["n", "cell"], "left").select("n", "cell", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("vec_id", "v"), F.col("salts"))).otherwise(0).cast("int").alias("salt"), "vec_id", "v")
    queries = every.filter(is_query).select(F.xxhash64("vec_id", "v").alias("qkey"), F.col("vec_id").alias("query_id"), "v", "n", "cell", "p").dropDuplicates(["qkey"])
    fields = "n int, cell int, salt int, qkey long, query_id long, least double, v array<double>"

    def routed(home: bool):
        """A query's blocks: those of its own cell, or those of the other cells that are still open."""

        def run(batches):
            for batch in batches:
                out = []
                for i, (n, cell, p, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)))):
                    cells, counts, box_of = shared.value[n]
                    p = np.array(p)
                    gap = np.maximum(np.maximum(box_of[:, :dims] - p, p - box_of[:, dims:]), 0)
                    go = cells == cell if home else (cells != cell) & ~((least >= -1) & shut((gap * gap).sum(axis=1), least, limit))
                    out += [(i, n, c, s, least) for c, m in zip(cells[go].tolist(), counts[go].tolist()) for s in range(m)]
                for a in range(0, len(out), 5_000):
                    i, n, c, s, least = zip(*out[a : a + 5_000])
                    own = pa.array(i, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(c, pa.int32()), pa.array(s, pa.int32()), batch.column(0).take(own), batch.column(1).take(own), pa.array(least, pa.float64()), batch.column(2).take(own)], names=["n", "cell", "salt", "qkey", "query_id", "least", "v"])

        return run

    at_home = queries.withColumn("least", F.lit(-2.0)).mapInArrow(routed(True), fields)
    first = settle(searched(rows, at_home, k, limit, dims, seed))
    best = first.groupBy("qkey").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("qkey", F.when(F.size("s") >= k, F.col("s")[k - 1]).alias("kth"))
    known = queries.join(best, "qkey", "left").withColumn("least", F.coalesce("kth", F.lit(-2.0))).drop("kth")
    away = settle(known.select("qkey", "query_id", "v", "n", "cell", "p", "least").mapInArrow(routed(False), fields))
    found = first.unionByName(searched(rows, away, k, limit, dims, seed))
    blocks = at_home.select("qkey").unionByName(away.select("qkey")).groupBy("qkey").agg(F.count(F.lit(1)).alias("n_blocks"))
    by = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(blocks, "qkey").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_blocks")


def op4_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op4_stable_projections": op4_stable_projections}
