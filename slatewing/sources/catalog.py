"""Tables of a folder as temp views: declared ones over pipe-delimited files, others over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slatewing.sources.ddl import Table
from slatewing.sources.pipe import read_pipe

ENDINGS = (".dat", ".tbl", ".csv")


def entries(spark: SparkSession, folder: str) -> dict[str, str]:
    """Lower-case names of what lies in a folder, by any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return {x.getPath().getName().lower(): x.getPath().toString() for x in found}


class Catalog:
    """Names are not case-sensitive, neither for tables nor for files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables, self.paths = spark, folder.rstrip("/"), {}, {}
        self.files = entries(spark, self.folder)

    def declare(self, table: Table) -> DataFrame:
        """Registers a declared table over NAME.dat, NAME.tbl, NAME.csv or NAME.parquet; without such a
        file it is an error, not an empty table."""
        name = table.name.lower()
        path = next((self.files[name + x] for x in (*ENDINGS, ".parquet") if name + x in self.files), None)
        if not path:
            raise FileNotFoundError(f"no file for table {table.name} in {self.folder}")
        self.tables[name], self.paths[name] = table, path
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        """The declared table's rows, (again) as the view of that name."""
        path = self.paths[name]
        df = self.spark.read.parquet(path) if path.lower().endswith(".parquet") else read_pipe(self.spark, path, self.tables[name].schema)
        df.createOrReplaceTempView(name)
        return df

    def parquet(self, *names: str) -> dict[str, DataFrame]:
        """Registers Parquet tables of the folder, all if none is named."""
        own = [n.lower() for n in names] or [f.removesuffix(".parquet") for f in self.files if f.endswith(".parquet")]
        out = {n: self.spark.read.parquet(self.files[f"{n}.parquet"]) for n in own}
        for n, df in out.items():
            df.createOrReplaceTempView(n)
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name.lower())
