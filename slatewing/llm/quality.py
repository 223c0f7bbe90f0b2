"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is described by its hashed byte trigrams (log counts, weighted by rarity, of length 1) beside a
block of shape shares (repeated words, letter case, digits, marks). The main directions of the labelled
sample's vectors give the latent space. Every document's cosines with all labelled vectors are
computed in blocks, and its ``neighbours`` nearest vote with a power of their cosine as weight.

The sample is bounded: at most ``sample`` labelled rows, the first by the hash of the id, whatever the
input's size; the model is fitted to it in one task, and only the model is broadcast. Scoring passes
once over all whole texts and shuffles nothing.

Defined results: null and empty texts get the share of label 1 in the sample; without any usable label
every score is 0.5. Labels that are null or not 0 or 1 are passed over; of several labels for one id the
majority counts, ties as 1. Equal texts get equal features. Of the documents only id and text are read,
unless columns to keep are named; clashing names in the label table do no harm.
"""

from __future__ import annotations

import operator
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm.common import DOC_COLUMNS, held_out, table

GRAMS = 1984
SHAPES = 11
SHAPE_WEIGHT = 1.2
#: Kinds of bytes: 1 upper case, 2 lower case, 3 digits, 4 white space, 5 stops, 6 beyond ASCII, 7 other marks.
KINDS = np.array([6 if b > 127 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r" else 5 if b in b",." else 7 if b > 32 else 0 for b in range(256)])


def features(text: bytes | None) -> np.ndarray:
    """Trigram counts and shape shares of one whole text."""
    out = np.zeros(GRAMS + SHAPES, np.float32)
    if not text:
        return out
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(x) > 2:
        h = (x[:-2] * np.uint32(2654435761)) ^ (x[1:-1] * np.uint32(2246822507)) ^ (x[2:] * np.uint32(3266489909))
        h ^= h >> np.uint32(15)
        h *= np.uint32(739982445)
        h ^= h >> np.uint32(13)
        out[:GRAMS] = np.bincount(h % np.uint32(GRAMS), minlength=GRAMS)
    words = text.split()
    n = max(1, len(words))
    out[GRAMS] = min(1, np.log1p(n) / 12)
    out[GRAMS + 1 : GRAMS + 9] = np.bincount(KINDS[x], minlength=8) / len(x)
    out[GRAMS + 9] = (len(words) - len(set(words))) / n
    out[GRAMS + 10] = sum(map(operator.eq, words, words[1:])) / n
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class LatentVote:
    """The fitted space, the labelled vectors in it, and their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dims: int, neighbours: int, power: int):
        self.neighbours, self.power, self.labels = neighbours, power, labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if len(rows):
            self.rarity = (np.log((1 + len(rows)) / (1 + (rows[:, :GRAMS] > 0).sum(axis=0))) + 0.1).astype(np.float32)
            plain = self.weighted(rows)
            _, axes = np.linalg.eigh(plain.T.astype(np.float64) @ plain)
            self.axes = axes[:, -dims:].astype(np.float32)
            self.vectors = unit(plain @ self.axes)

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        return unit(np.concatenate([unit(np.log1p(rows[:, :GRAMS]) * self.rarity), np.sqrt(rows[:, GRAMS:]) * np.float32(SHAPE_WEIGHT)], axis=1))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Exact cosines of a block of documents with all labelled vectors, and the vote."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        some = rows.any(axis=1)
        near = unit(self.weighted(rows) @ self.axes) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** self.power
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(some & (total > 0), vote, self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4096, dims: int = 48, neighbours: int = 15, power: int = 8) -> LatentVote:
    """Learns from the labelled rows that aren't held out, of which at most ``sample`` are gathered."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(3, 1))
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ids may repeat: the second limit bounds what is collected.
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample).select(F.col("text").cast("binary").alias("text"), "label")

    def learn(batches):
        matrix, known = [], []
        for batch in batches:
            matrix += [features(x.as_py()) for x in batch.column(0)]
            known += batch.column(1).to_pylist()
        if known:
            model = LatentVote(np.stack(matrix), np.array(known), dims, neighbours, power)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # Fitted in one task, so that neither the sample nor its matrices come to the driver.
    got = rows.coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0][0]) if got else LatentVote(np.zeros((0, GRAMS + SHAPES), np.float32), np.zeros(0), dims, neighbours, power)


def scored(docs: DataFrame, model: LatentVote, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float | None = None, block: int = 512) -> DataFrame:
    """The kept columns and ``score`` of every row, or only of rows that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("__text"))

    def run(batches):
        for batch in batches:
            texts, parts = batch.column(len(keep)), []
            for k in range(0, len(texts), block):
                parts.append(shared.value.score(np.stack([features(x.as_py()) for x in texts[k : k + block]])))
            score = np.concatenate(parts) if parts else np.zeros(0)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])
            yield out if least is None else out.filter(pa.array(score >= least))

    schema = kept.drop("__text").schema.add("score", "double")
    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = DOC_COLUMNS) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return scored(docs, fit(docs, labels), keep=columns, least=0.5).select(*columns)


def op2_latent_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op2_latent_vote": op2_latent_vote}
