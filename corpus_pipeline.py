"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before has kept, written as Parquet, and returns what it
keeps with the columns of ``documents``; the last gives the packing. Stages cut their own lineage in the
shared folder, so a lost executor costs tasks, not stages.

Nulls, empty and repeated rows have the results that the operators define; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slatewing.llm import chunks, decontaminate, packing, quality, simhash
from slatewing.llm.common import DOC_COLUMNS, scratch, table
from slatewing.sources.storage import CREATED, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latent-semantic vote doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), DOC_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity of 0.8 or more)."""
    return simhash.one_of_each(docs, DOC_COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated passages."""
    return chunks.rewritten(docs, DOC_COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*DOC_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: one row a piece."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]
#: The stages' hashing, learning and packing are beyond SQL; tests/llm hold the operators, and each stage on a
#: small table, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stored on the way is removed once its result is written;
    the last stage's input stays, as its rows are read when the result is."""
    docs, since = table(spark, sf_dir, "documents"), len(CREATED)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        release(spark, path, since=since)
    return docs
