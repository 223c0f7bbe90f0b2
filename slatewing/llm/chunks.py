"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes marks the cuts, so after an insertion the cuts fall in the
same places again. Chunks (at least ``LEAST``, at most ``MOST`` bytes, whole UTF-8 characters) with the
same 128-bit digest are copies. A run of neighbouring repeated chunks of ``run_bytes`` or more together
is a repeated passage: its first occurrence anywhere (smallest doc_id, then text, then place) stays and
its later ones are removed. Short repeats, such as one common phrase, are left alone.

Copies are counted, and their first place is found, by an aggregation that combines before the shuffle,
so a chunk found in a third of all documents costs a row for each task; no group is collected. Only
repeated chunks go back to their documents.

Defined results: null stays null, empty stays empty; equal rows (same id and text) count as one
document and get equal results; a null doc_id comes after all others. Every row of the input has its
row in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm.common import DOC_COLUMNS, stored, table

LEAST, MOST = 24, 192
WINDOW = 16
CUT_BITS = 5
RUN_BYTES = 96


def gear_table() -> np.ndarray:
    """256 mixed 32-bit values from a multiplicative rule; byte 0 counts nothing, so that zeros part texts."""
    x = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def rolling(x: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 16 bytes' values, each shifted by its age."""
    h = GEAR[x]
    age = 1
    while age < WINDOW:
        h[age:] += h[:-age] << np.uint32(age)
        age *= 2
    return h


def chunk_bounds(text: bytes) -> list[int]:
    """0, the ends of the chunks of one text."""
    return batch_bounds([text])[0]


def batch_bounds(texts: list[bytes]) -> list[list[int]]:
    """The chunks' bounds in each text; the rolling hash runs over all texts at once, parted by zeros."""
    x = np.frombuffer((b"\0" * WINDOW).join(texts), np.uint8)
    if not len(x):
        return [[0] for _ in texts]
    cut = ((rolling(x) >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1)) == 0
    cut[:-1] &= (x[1:] & 0xC0) != 0x80
    ends = np.flatnonzero(cut) + 1
    out, at = [], 0
    for text in texts:
        n, start, bounds = len(text), 0, [0]
        lo, hi = np.searchsorted(ends, (at + 1, at + n))
        for end in (*(ends[lo:hi] - at).tolist(), n):
            while end - start > MOST:
                stop = start + MOST
                while stop > start + 1 and text[stop] & 0xC0 == 0x80:
                    stop -= 1
                bounds.append(stop)
                start = stop
            if end - start >= LEAST or end == n > start:
                bounds.append(end)
                start = end
        out.append(bounds)
        at += n + WINDOW
    return out


def chunk_rows(texts: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, k1, at) of every chunk of rows (doc_id, k1, text as bytes); ``at`` is the start
    times 256 plus the size."""

    def run(batches):
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            ids, keys, column = batch.column(0), np.asarray(batch.column(1)), batch.column(2)
            k = 0
            while k < len(column):
                part, held = [], 0
                first = k
                while k < len(column) and held < 1 << 21:
                    part.append(column[k].as_py())
                    held += len(part[-1])
                    k += 1
                digests, starts, sizes, counts = [], [], [], []
                for text, bounds in zip(part, batch_bounds(part)):
                    digests += [digest(text[a:b]) for a, b in zip(bounds, bounds[1:])]
                    ends = np.array(bounds, np.int64)
                    starts.append(ends[:-1])
                    sizes.append(np.diff(ends))
                    counts.append(len(bounds) - 1)
                if digests:
                    pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    which = np.repeat(np.arange(first, k), counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), ids.take(pa.array(which)), pa.array(keys[which]), pa.array(np.concatenate(starts) << 8 | np.concatenate(sizes))],
                        names=["d1", "d2", "doc_id", "k1", "at"],
                    )

    return texts.mapInArrow(run, "d1 long, d2 long, doc_id long, k1 long, at long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, chunks): for each document with repeated chunks their (start, size, first) in order."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), text.cast("binary").alias("text")).filter(F.length("text") > 0)
    rows = chunk_rows(texts)  # cut twice: that costs less than storing them
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "at")
    known = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Stored, so that both sides of the join are plain shuffles and the rows of a hot digest can be split.
    known = stored(known.select("d1", "d2", F.xxhash64("first.doc_id", "first.k1", "first.at").alias("first")), "repeated")
    again = rows.join(known, ["d1", "d2"]).select("doc_id", "k1", F.shiftright("at", 8).alias("start"), F.col("at").bitwiseAND(255).alias("size"), (F.xxhash64("doc_id", "k1", "at") == F.col("first")).alias("first")).distinct()
    return again.groupBy("doc_id", "k1").agg(F.array_sort(F.collect_list(F.struct("start", "size", "first"))).alias("chunks"))


def spans_of(starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, run_bytes: int) -> list[tuple[int, int]]:
    """The byte ranges to remove: in runs of neighbouring repeated chunks that are long enough, all but
    first occurrences."""
    if not len(starts):
        return []
    ends = starts + sizes
    run = np.r_[0, np.cumsum(starts[1:] != ends[:-1])]
    gone = (np.bincount(run, weights=sizes)[run] >= run_bytes) & ~first
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[gone].tolist(), ends[gone].tolist()):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), run_bytes: int = RUN_BYTES) -> DataFrame:
    """Every row: the kept columns, doc_id, text (what remains), n_bytes, n_repeated, n_removed, n_spans."""
    text = F.col(text_col).cast("string")
    kept = docs.select(*[F.col(c).alias(f"c_{c}") for c in keep], F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"), text.cast("binary").alias("own_text"))
    found = repeats(docs, id_col, text_col)
    joined = kept.join(found, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("k1")), "left")
    lists = joined.select(*[f"c_{c}" for c in keep], "own_id", "own_text", F.col("chunks.start").alias("starts"), F.col("chunks.size").alias("sizes"), F.col("chunks.first").alias("firsts"))

    def run(batches):
        for batch in batches:
            n = len(keep)
            texts, starts, sizes, firsts = (batch.column(n + 1 + i) for i in range(4))
            out, counts = [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                if text is None or not starts[i].is_valid:
                    out.append(text)
                    counts.append((len(text or b""), 0, 0, 0))
                    continue
                a, b, c = (np.asarray(x[i].values) if x is not firsts else np.asarray(x[i].values.to_numpy(zero_copy_only=False), bool) for x in (starts, sizes, firsts))
                gone, parts, at = spans_of(a.astype(np.int64), b.astype(np.int64), c, run_bytes), [], 0
                for s, e in gone:
                    parts.append(text[at:s])
                    at = e
                out.append(b"".join(parts) + text[at:])
                counts.append((len(text), len(a), sum(e - s for s, e in gone), len(gone)))
            counts = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array([None if x is None else x.decode() for x in out], pa.string()), *[pa.array(counts[:, i].copy()) for i in range(4)]], names=[*[f"c_{c}" for c in keep], "doc_id", "text", "n_bytes", "n_repeated", "n_removed", "n_spans"])

    schema = lists.select(*[f"c_{c}" for c in keep]).schema.add("doc_id", "long").add("text", "string").add("n_bytes", "long").add("n_repeated", "long").add("n_removed", "long").add("n_spans", "long")
    return lists.mapInArrow(run, schema)


def rewritten(docs: DataFrame, columns: tuple[str, ...] = DOC_COLUMNS) -> DataFrame:
    """The documents with later copies of repeated passages cut out of the text; n_chars follows."""
    own = [c for c in columns if c not in ("doc_id", "text", "n_chars")]
    done = deduplicated(docs, keep=tuple(own))
    value = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col(f"c_{c}") for c in own}
    return done.select(*[value[c].alias(c) for c in columns])


def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "text")


SQL: dict[str, str] = {}
QUERIES = {"op6_gear_chunks": op6_gear_chunks}
