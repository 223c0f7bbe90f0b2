"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most ``capacity`` words. Pieces of full capacity fill a bin alone;
the rest are packed, longest first, each into the bin with the smallest sufficient residual that holds
neither its source nor its duplicate cluster. Open bins are ordered by residual and grouped by their
pair of bitmaps (sources, clusters), so the successor search passes over thousands of bins with the
same conflict in one step and goes on until the tightest compatible bin is found.

Shards: the rows (ids, lengths and two hashes, never the text) are dealt round robin to shards of about
``shard_rows``, whatever their keys, so that a hot source or a large group of copies is spread evenly
and a shard's state is bounded. Every shard packs on its own, at the cost of a few open bins each.

Defined results: a null or empty text has length 0 and occupies no room, but its row is kept in a bin;
a null source conflicts with no other; equal rows are of one cluster and go to different bins; a null
cluster column value conflicts with nothing. Documents longer than the capacity appear once a piece.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm.common import lowered, table

CAPACITY = 2048
SCHEMA = "bin_id long, doc_id long, piece int, first_word long, n_words long, bin_offset long, bin_words long"


class Bins:
    """Open bins of one shard by residual; ``free`` has bit r set while some bin has r words left.
    Bitmaps are exact whole numbers of any width: one bit for each source and each repeated cluster."""

    def __init__(self, capacity: int):
        self.capacity, self.free = capacity, 0
        self.at: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.left: list[int] = []

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``need`` words with these bits."""
        r, later = need, self.free >> need
        while later:
            step = (later & -later).bit_length() - 1
            r, later = r + step, later >> step
            for signature in self.at[r]:
                if not (signature[0] & source or signature[1] & cluster):
                    return self.fill(self.take(r, signature), need, signature, source, cluster)
            r, later = r + 1, later >> 1
        self.left.append(self.capacity)
        return self.fill(len(self.left) - 1, need, (0, 0), source, cluster)

    def take(self, r: int, signature: tuple[int, int]) -> int:
        groups = self.at[r]
        b = groups[signature].pop()
        if not groups[signature]:
            del groups[signature]
            if not groups:
                del self.at[r]
                self.free &= ~(1 << r)
        return b

    def fill(self, b: int, need: int, signature: tuple[int, int], source: int, cluster: int) -> tuple[int, int]:
        offset = self.capacity - self.left[b]
        self.left[b] = r = self.left[b] - need
        self.at.setdefault(r, {}).setdefault((signature[0] | source, signature[1] | cluster), []).append(b)
        self.free |= 1 << r
        return b, offset


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit, longest piece first, ties by id, for rows (doc_id, n_words, source, cluster)."""
    rows = rows.sort_values(["n_words", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable", na_position="last")
    copies = rows["cluster"].value_counts()
    bit = {k: 1 << i for i, k in enumerate(copies.index[copies > 1])}
    named = {k: 1 << i for i, k in enumerate(rows["source"].dropna().unique())}
    bins, out, rest = Bins(capacity), [], []
    for doc_id, n, source, cluster in zip(rows["doc_id"], rows["n_words"], rows["source"], rows["cluster"]):
        whole, tail = divmod(n, capacity)
        keys = named.get(source, 0), bit.get(cluster, 0)
        for k in range(whole):
            bins.left.append(0)
            out.append((len(bins.left) - 1, doc_id, k, k * capacity, capacity, 0))
        if tail or not whole:
            rest.append((tail, doc_id, whole, keys))
    rest.sort(key=lambda x: -x[0])
    for tail, doc_id, whole, keys in rest:
        b, offset = bins.place(tail, *keys)
        out.append((b, doc_id, whole, whole * capacity, tail, offset))
    pdf = pd.DataFrame(out, columns=["bin_id", "doc_id", "piece", "first_word", "n_words", "bin_offset"], dtype=object)
    pdf["bin_words"] = [capacity - bins.left[x[0]] for x in out]
    return pdf


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """One row for every piece: its bin, its first word and number of words, its offset in the bin and
    the words in the whole bin. Without ``cluster_col`` texts equal but for the case of A-Z are a cluster.
    A bin's number is the shard's times 2**32 plus its own."""

    def pack(batches):
        from pyspark import TaskContext

        parts = [x for x in batches if len(x)]
        if parts:
            pdf = pack_shard(pd.concat(parts, ignore_index=True), capacity)
            pdf["bin_id"] = pdf["bin_id"].astype("int64") + (TaskContext.get().partitionId() << 32)
            yield pdf.astype({"doc_id": "Int64", "piece": "int32", "first_word": "int64", "n_words": "int64", "bin_offset": "int64", "bin_words": "int64"})

    cluster = F.xxhash64(lowered(text_col)) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(F.col(cluster_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    typed = lambda batches: pack(x.astype({"doc_id": "Int64", "cluster": "Int64"}) for x in batches)
    return rows.repartition(shards).mapInPandas(typed, SCHEMA)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op5_best_fit": op5_best_fit}
