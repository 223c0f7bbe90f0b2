"""Pipe-delimited text: reading with a declared schema, writing and printing without header or quotes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pipe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of ``path``. An empty field is null; the empty column after a closing ``|`` is passed over;
    blanks are kept; a quote is an ordinary character."""
    return spark.read.schema(schema).option("sep", "|").option("quote", "").option("dateFormat", "yyyy-M-d").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def line(df: DataFrame, null: str = "") -> Column:
    """All columns of a row as one pipe-joined text."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns])


def write_pipe(df: DataFrame, path: str, null: str = "") -> None:
    """Every row as a line in text files under ``path``."""
    df.select(line(df, null).alias("value")).write.text(path)


def lines(df: DataFrame, null: str = "null") -> Iterator[str]:
    """The result's lines in order, a partition at a time on the driver."""
    for row in df.select(line(df, null).alias("value")).toLocalIterator(prefetchPartitions=True):
        yield row[0]
