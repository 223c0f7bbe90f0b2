"""Single-column indexes as sorted copies of a table.

An index is the whole table range-partitioned and sorted by the key in Parquet. Point and range lookups
are plain filters: their bounds reach the files' and row groups' statistics, so other files are skipped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.sources.catalog import Catalog, entries

FILE_BYTES = 256 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class IndexStore:
    """Named TABLE_COLUMN_PK or TABLE_COLUMN_IDX under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str, column: str, kind: str) -> str:
        return f"{self.folder}/{table.upper()}_{column.upper()}_{kind}"

    def build(self, df: DataFrame, table: str, column: str, kind: str = "IDX", files: int | None = None) -> str:
        """Writes the sorted copy; an older one of that name is replaced."""
        files = files or max(2, math.ceil(plan_bytes(df) / FILE_BYTES))
        path = self.path(table, column, kind)
        df.repartitionByRange(files, column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)
        return path

    def build_all(self, catalog: Catalog) -> list[str]:
        """Indexes of all declared tables of a catalog."""
        return [self.build(catalog.table(name), name, column, kind) for name, table in catalog.tables.items() for kind, columns in table.keys.items() for column in columns]

    def choose(self, table: str, column: str, join: bool = False) -> str | None:
        """The index to use: for filters a secondary one is preferred, for joins the primary one."""
        try:
            there = entries(self.spark, self.folder)
        except Exception as e:  # the JVM's FileNotFoundException: nothing has been built
            if "FileNotFoundException" in str(e):
                return None
            raise
        for kind in ("PK", "IDX") if join else ("IDX", "PK"):
            if (found := there.get(f"{table}_{column}_{kind}".lower())) is not None:
                return found
        return None

    def open(self, table: str, column: str, join: bool = False) -> DataFrame:
        found = self.choose(table, column, join)
        if found is None:
            raise KeyError(f"no index of {table} by {column}")
        return self.spark.read.parquet(found)

    def lookup(self, table: str, column: str, value) -> DataFrame:
        """All rows with this key (none for null)."""
        return self.open(table, column).filter(F.col(column) == F.lit(value))

    def between(self, table: str, column: str, low=None, high=None, low_open: bool = False, high_open: bool = False, residual: Column | None = None) -> DataFrame:
        """Rows in a one- or two-sided range, bounds included unless open, and a further condition."""
        df, key = self.open(table, column), F.col(column)
        if low is not None:
            df = df.filter(key > F.lit(low) if low_open else key >= F.lit(low))
        if high is not None:
            df = df.filter(key < F.lit(high) if high_open else key <= F.lit(high))
        return df if residual is None else df.filter(residual)
