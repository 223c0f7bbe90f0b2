from pyspark.sql import functions as F

from slatewing.functions.compat import ci, float_text, fold, logical_and, logical_or, logical_xor, trunc_div
from slatewing.operators.relational import aggregate, join, join_all, join_lookup, project, sort, top, where


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_projection_and_filter(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0)], "a int, b double")
    assert rows(project(df, "a", c=F.col("a") * F.col("b"))) == [(1, 2.0), (None, None)]
    assert rows(where(df, F.col("a") > 0, F.col("b") < 3)) == [(1, 2.0)]
    assert where(df).count() == 2


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (-2, "y"), (None, "z")], "k int, s string").alias("a")
    b = spark.createDataFrame([(1, 10), (-2, 20), (None, 30)], "k int, v int").alias("b")
    equal = F.col("a.k") == F.col("b.k")
    assert rows(project(join(a, b, equal), "s", "v")) == [("x", 10), ("y", 20)]
    assert join(a, b).count() == 9
    assert rows(project(join(a, b, F.col("a.k") < F.col("b.k")), "s", "v")) == [("y", 10)]
    assert join_all(a, (b, equal), (b.alias("c"), F.col("c.k") == F.col("a.k"))).count() == 2
    for most in (0, 1 << 30):
        plan = join_lookup(a, b, equal, most)
        assert plan.count() == 2
    small = join_lookup(a, spark.range(5), F.col("a.k") == F.col("id"))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_aggregates(spark):
    df = spark.createDataFrame([("1", "23", 1), ("12", "3", 2), ("a", "A", None), ("A", "a", 4)], "g string, h string, n int")
    assert aggregate(df, "g", "h", n=F.count(F.lit(1))).count() == 4
    assert aggregate(df, fold("g").alias("g"), n=F.count("n")).filter("g = 'a'").first()["n"] == 1
    empty = df.filter("n > 100")
    assert rows(aggregate(empty, n=F.count(F.lit(1)), s=F.sum("n"), m=F.min("n"), x=F.max("n"), a=F.avg("n"))) == [(0, None, None, None, None)]
    assert rows(aggregate(df, d=F.countDistinct("n"), c=F.count("n"), a=F.avg("n"))) == [(3, 3, 7 / 3)]
    assert aggregate(df, "g", any_of=("h",), n=F.count(F.lit(1))).columns == ["g", "h", "n"]


def test_sort_and_top(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (1, "a")], "x int, y string")
    assert [tuple(r) for r in sort(df, F.desc("x"), "y").collect()] == [(2, "a"), (1, "a"), (1, "b")]
    best = top(df, 2, "x", F.desc("y"))
    assert [tuple(r) for r in best.collect()] == [(1, "b"), (1, "a")]
    assert "TakeOrderedAndProject" in best._jdf.queryExecution().executedPlan().toString()


def test_compat(spark):
    df = spark.createDataFrame([(7, 2, "AbC"), (-7, 2, "abd"), (5, 0, None)], "a int, b int, s string")
    assert [r[0] for r in df.select(trunc_div("a", "b")).collect()] == [3.0, -3.0, None]
    assert rows(df.filter(ci("=", "s", F.lit("aBc"))).select("a")) == [(7,)]
    assert rows(df.filter(ci(">", "s", F.lit("ABC"))).select("a")) == [(-7,)]
    assert df.select(float_text(F.lit(38.47826086))).first()[0] == "38.47826"
    t, f = F.lit(True), F.lit(False)
    assert tuple(df.select(logical_and(t, f), logical_or(t, f), logical_xor(t, t), logical_xor(t, f)).first()) == (False, True, False, True)
