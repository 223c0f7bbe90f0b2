import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewing.sources.ddl import parse_create
from slatewing.sources.index import IndexStore
from slatewing.sources.pipe import lines, read_pipe, write_pipe
from slatewing.sources.types import spark_type


def test_declared_types():
    assert spark_type("decimal") == spark_type("DECIMAL(15,2)") == spark_type("float") == T.DoubleType()
    assert spark_type("char(25)") == spark_type("VARCHAR (44)") == spark_type("string") == spark_type("blob") == T.StringType()
    assert (spark_type("int"), spark_type("date"), spark_type("bool")) == (T.IntegerType(), T.DateType(), T.BooleanType())


def test_create_table_with_keys():
    t = parse_create("CREATE TABLE LINEITEM (orderkey INT, quantity DECIMAL(15, 2), mode CHAR(10) , ship DATE, PRIMARY KEY (orderkey, mode), INDEX shipidx (ship), primary key(orderkey))")
    assert [(f.name, f.dataType.simpleString()) for f in t.schema] == [("orderkey", "int"), ("quantity", "double"), ("mode", "string"), ("ship", "date")]
    assert t.keys == {"PK": ("orderkey",), "IDX": ("ship",)}
    with pytest.raises(ValueError, match="not a CREATE"):
        parse_create("select 1")


def test_pipe_text(spark, tmp_path):
    (tmp_path / "x.dat").write_text('1|a"b| c|1995-01-1|2.5|\n2||||\n3|"q|d|1996-12-31|0.05|')
    schema = parse_create("create table x(i int, s string, t char(3), d date, f decimal)").schema
    got = [tuple(r) for r in read_pipe(spark, f"file://{tmp_path}/x.dat", schema).collect()]
    assert got == [(1, 'a"b', " c", datetime.date(1995, 1, 1), 2.5), (2, None, None, None, None), (3, '"q', "d", datetime.date(1996, 12, 31), 0.05)]


def test_pipe_round_trip_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None, 0.5), (2, None, datetime.date(2000, 1, 2), 1e9)], "a int, b string, c date, d double")
    write_pipe(df, f"file://{tmp_path}/out")
    back = read_pipe(spark, f"file://{tmp_path}/out", df.schema)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert list(lines(df.orderBy("a"))) == ["1|x|null|0.5", "2|null|2000-01-02|1.0E9"]


def test_index_bounds_and_pruning(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 100).cast("int").alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k int, id long"))
    store = IndexStore(spark, f"file://{tmp_path}/ix")
    assert store.choose("T", "k") is None
    store.build(df, "t", "k", "PK", files=8)
    assert store.choose("T", "K").endswith("T_K_PK")
    store.build(df, "t", "k", "IDX", files=8)
    assert store.choose("t", "k").endswith("_IDX") and store.choose("t", "k", join=True).endswith("_PK")
    n = lambda df: df.count()
    assert n(store.lookup("t", "k", 7)) == 10
    assert n(store.lookup("t", "k", 500)) == n(store.lookup("t", "k", None)) == 0
    assert n(store.between("t", "k", 10, 20)) == 110
    assert n(store.between("t", "k", 10, 20, low_open=True, high_open=True)) == 90
    assert n(store.between("t", "k", 98)) == 20 and n(store.between("t", "k", high=1)) == 20
    assert n(store.between("t", "k", 10, 20, residual=F.col("id") < 100)) == 11
    hit = store.lookup("t", "k", 7)
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,7)]" in hit._jdf.queryExecution().executedPlan().toString()
    assert hit.select(F.input_file_name()).distinct().count() == 1
    with pytest.raises(KeyError):
        store.open("t", "other")
