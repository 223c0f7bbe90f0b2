import pytest
from awkward_rows import ROWS, TABLES


def write(spark, base, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.mode("overwrite").parquet(f"file://{base}/{name}.parquet")
    return f"file://{base}"


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("awkward"), ROWS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {k: [] for k in TABLES})


@pytest.fixture(scope="session")
def documents(spark, awkward):
    return spark.read.parquet(f"{awkward}/documents.parquet")


CLASHING = ("k1", "k2", "w", "x", "pos", "seed", "print", "node", "root", "h", "s", "place", "score", "row", "rare", "token", "n", "own_id", "own_text", "starts", "cluster", "n_words", "component_id", "spans", "copies", "held_out", "vec_id", "rank")


@pytest.fixture(scope="session")
def clashing(documents):
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])
