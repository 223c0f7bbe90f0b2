"""What the operators of this subpackage share: shared folders, small checks, hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.sources.storage import scratch, shared_dir

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows lie in the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """As settle, but as compressed Parquet, for wide rows."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowered(column: str = "text"):
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), UPPER, LOWER)


def held_out(modulus: int, remainder: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
