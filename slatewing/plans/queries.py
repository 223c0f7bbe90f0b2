"""The registered queries: each operator over the shared tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.functions.compat import any_of_group, ci, float_text, fold, logical_and, logical_or, logical_xor, trunc_div
from slatewing.operators.relational import aggregate, join, join_all, join_lookup, project, sort, top, where
from slatewing.plans.script import run
from slatewing.sources.catalog import Catalog
from slatewing.sources.index import IndexStore
from slatewing.sources.pipe import line, read_pipe, write_pipe
from slatewing.sources.storage import scratch

col = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def day(text: str):
    return F.to_timestamp_ntz(F.lit(f"{text} 00:00:00"))


def query(sql: str | None):
    """Registers a function of the tables under its name."""

    def keep(f):
        def over(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        register(f.__name__, over, sql)
        return f

    return keep


def register(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def scripted(name: str, text: str, *tables: str, loose: bool = False, sql: str | None = None, oracle: bool = True) -> None:
    """Registers the last query of a script over Parquet tables; its text is its own twin."""

    def over(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog(spark, sf_dir)
        catalog.parquet(*tables)
        return list(run(spark, text, catalog, loose))[-1]

    register(name, over, (sql or text).rstrip(" ;") if oracle else None)


def cents(c):
    return F.round(F.sum(c), 2)


@query(
    """
    select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
           round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 4) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= date '1998-09-01' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus
    """
)
def q1_pricing_summary(t):
    net = col("l_extendedprice") * (1 - col("l_discount"))
    rows = where(t("lineitem"), col("l_shipdate") <= day("1998-09-01"))
    sums = aggregate(
        rows, "l_returnflag", "l_linestatus", sum_qty=cents(col("l_quantity")), sum_base_price=cents(col("l_extendedprice")), sum_disc_price=cents(net), sum_charge=cents(net * (1 + col("l_tax"))),
        avg_qty=F.round(F.avg("l_quantity"), 4), avg_price=F.round(F.avg("l_extendedprice"), 4), avg_disc=F.round(F.avg("l_discount"), 4), count_order=F.count(F.lit(1)),
    )
    return sort(sums, "l_returnflag", "l_linestatus")


@query(
    """
    select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate, o_orderpriority
    from customer, orders, lineitem
    where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15'
    group by l_orderkey, o_orderdate, o_orderpriority order by revenue desc, o_orderdate, l_orderkey
    """
)
def q3_shipping_priority(t):
    wide = join_all(
        where(t("customer"), col("c_mktsegment") == "BUILDING"),
        (where(t("orders"), col("o_orderdate") < day("1995-03-15")), col("c_custkey") == col("o_custkey")),
        (where(t("lineitem"), col("l_shipdate") > day("1995-03-15")), col("l_orderkey") == col("o_orderkey")),
    )
    sums = aggregate(wide, "l_orderkey", "o_orderdate", "o_orderpriority", revenue=cents(col("l_extendedprice") * (1 - col("l_discount"))))
    return sort(sums.select("l_orderkey", "revenue", "o_orderdate", "o_orderpriority"), F.desc("revenue"), "o_orderdate", "l_orderkey")


@query(
    """
    select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from customer, orders, lineitem, nation
    where c_custkey = o_custkey and l_orderkey = o_orderkey and c_nationkey = n_nationkey and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'
    group by n_name order by revenue desc, n_name
    """
)
def q5_nation_revenue(t):
    wide = join_all(
        where(t("orders"), col("o_orderdate") >= day("1996-01-01"), col("o_orderdate") < day("1997-01-01")),
        (t("customer"), col("c_custkey") == col("o_custkey")),
        (t("lineitem"), col("l_orderkey") == col("o_orderkey")),
        (t("nation"), col("c_nationkey") == col("n_nationkey")),
    )
    return sort(aggregate(wide, "n_name", revenue=cents(col("l_extendedprice") * (1 - col("l_discount")))), F.desc("revenue"), "n_name")


@query(
    """
    select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
    where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and l_discount > 0.06 - 0.01 and l_discount < 0.06 + 0.01 and l_quantity < 24
    """
)
def q6_forecast_revenue(t):
    rows = where(t("lineitem"), col("l_shipdate") >= day("1996-01-01"), col("l_shipdate") < day("1997-01-01"), F.expr("l_discount > 0.06 - 0.01 and l_discount < 0.06 + 0.01"), col("l_quantity") < 24)
    return aggregate(rows, revenue=cents(col("l_extendedprice") * col("l_discount")))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def proj_arith_alias(t):
    return project(t("lineitem"), "l_orderkey", "l_linenumber", net=F.round(col("l_extendedprice") * (1 - col("l_discount")), 4))


@query("select * from nation")
def select_star(t):
    return project(t("nation"), "*")


@query("select n.*, r_name from nation n, region where n_regionkey = r_regionkey")
def select_star_of_one(t):
    n = t("nation").alias("n")
    return project(join(n, t("region"), col("n_regionkey") == col("r_regionkey")), "n.*", "r_name")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 50000 and o_totalprice < 100000")
def filter_range_conj(t):
    return project(where(t("orders"), col("o_totalprice") >= 50000, col("o_totalprice") < 100000), "o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber from lineitem where l_extendedprice / l_quantity > 1500")
def filter_arith_lhs(t):
    return project(where(t("lineitem"), col("l_extendedprice") / col("l_quantity") > 1500), "l_orderkey", "l_linenumber")


@query("select o_orderkey, o_orderpriority from orders where (o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH') and o_orderstatus = 'F'")
def filter_or_paren(t):
    urgent = logical_or(col("o_orderpriority") == "1-URGENT", col("o_orderpriority") == "2-HIGH")
    return project(where(t("orders"), logical_and(urgent, col("o_orderstatus") == "F")), "o_orderkey", "o_orderpriority")


@query("select p_partkey, p_size from part where p_size between 10 and 20")
def filter_between(t):
    return project(where(t("part"), col("p_size").between(10, 20)), "p_partkey", "p_size")


@query("select c_custkey from customer where c_mktsegment <> 'BUILDING'")
def filter_not_equal(t):
    return project(where(t("customer"), col("c_mktsegment") != "BUILDING"), "c_custkey")


@query("select c_custkey, c_mktsegment from customer where lower(c_mktsegment) = lower('bUiLdInG')")
def filter_string_ci(t):
    return project(where(t("customer"), ci("=", "c_mktsegment", F.lit("bUiLdInG"))), "c_custkey", "c_mktsegment")


@query("select c_custkey, c_mktsegment from customer where lower(c_mktsegment) > lower('furniture') and lower(c_mktsegment) <= lower('Machinery')")
def filter_string_ci_order(t):
    return project(where(t("customer"), ci(">", "c_mktsegment", F.lit("furniture")), ci("<=", "c_mktsegment", F.lit("Machinery"))), "c_custkey", "c_mktsegment")


@query("select l_orderkey, l_linenumber, l_discount, l_tax from lineitem where l_discount < l_tax")
def filter_col_col(t):
    return project(where(t("lineitem"), col("l_discount") < col("l_tax")), "l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("select p_partkey from part where (p_size > 25) <> (p_retailprice > 1500)")
def filter_xor(t):
    return project(where(t("part"), logical_xor(col("p_size") > 25, col("p_retailprice") > 1500)), "p_partkey")


@query("select o_orderkey from orders where o_orderdate >= date '1996-01-01' and o_orderdate <= date '1996-01-31'")
def filter_date_text(t):
    return project(where(t("orders"), col("o_orderdate") >= F.to_date(F.lit("1996-01-1"), "yyyy-M-d"), col("o_orderdate") <= F.lit("1996-01-31").cast("timestamp_ntz")), "o_orderkey")


@query("select c_custkey, o_orderkey from customer, orders where c_custkey = o_custkey")
def join_equi(t):
    return project(join(t("customer"), t("orders"), col("c_custkey") == col("o_custkey")), "c_custkey", "o_orderkey")


@query("select a.n_name as name_a, b.n_name as name_b from nation a, nation b where a.n_regionkey = b.n_regionkey")
def join_self_alias(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return project(join(a, b, col("a.n_regionkey") == col("b.n_regionkey")), name_a=col("a.n_name"), name_b=col("b.n_name"))


@query("select a.n_nationkey as key_a, b.n_nationkey as key_b from nation a, nation b where b.n_nationkey - a.n_nationkey > 10")
def join_theta(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return project(join(a, b, col("b.n_nationkey") - col("a.n_nationkey") > 10), key_a=col("a.n_nationkey"), key_b=col("b.n_nationkey"))


@query("select a.p_partkey as key_a, b.p_partkey as key_b from part a join part b on a.p_size < b.p_size and a.p_retailprice > b.p_retailprice where a.p_size >= 48")
def join_on_theta(t):
    a, b = where(t("part"), col("p_size") >= 48).alias("a"), t("part").alias("b")
    return project(join(a, b, col("a.p_size") < col("b.p_size"), col("a.p_retailprice") > col("b.p_retailprice")), key_a=col("a.p_partkey"), key_b=col("b.p_partkey"))


@query("select r_name, n_name from region, nation")
def cross_join(t):
    return project(join(t("region"), t("nation")), "r_name", "n_name")


@query("select o_orderkey, l_linenumber from orders, lineitem where o_orderkey = l_orderkey and (o_orderstatus = 'F' or l_returnflag = 'R')")
def join_post_filter_or(t):
    wide = join(t("orders"), t("lineitem"), col("o_orderkey") == col("l_orderkey"))
    return project(where(wide, (col("o_orderstatus") == "F") | (col("l_returnflag") == "R")), "o_orderkey", "l_linenumber")


@query("select count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as least, max(o_totalprice) as most from orders")
def agg_global(t):
    p = col("o_totalprice")
    return aggregate(t("orders"), n=F.count(F.lit(1)), total=cents(p), mean=F.round(F.avg(p), 4), least=F.min(p), most=F.max(p))


@query("select c_mktsegment, count(*) as n, count(c_acctbal) as n_col from customer group by c_mktsegment")
def agg_group_count(t):
    return aggregate(t("customer"), "c_mktsegment", n=F.count(F.lit(1)), n_col=F.count("c_acctbal"))


@query("select l_returnflag, min(l_shipdate) as first_ship, max(l_extendedprice) as most from lineitem group by l_returnflag")
def agg_group_min_max(t):
    return aggregate(t("lineitem"), "l_returnflag", first_ship=F.min("l_shipdate"), most=F.max("l_extendedprice"))


@query("select count(distinct o_custkey) as n from orders")
def agg_count_distinct(t):
    return aggregate(t("orders"), n=F.countDistinct("o_custkey"))


@query("select o_orderstatus, count(distinct o_custkey) as n from orders group by o_orderstatus")
def agg_group_count_distinct(t):
    return aggregate(t("orders"), "o_orderstatus", n=F.countDistinct("o_custkey"))


@query("select p_brand, round(avg(p_size), 4) as mean, cast(sum(p_size) as bigint) as total from part group by p_brand")
def agg_int_avg(t):
    return aggregate(t("part"), "p_brand", mean=F.round(F.avg("p_size"), 4), total=F.sum("p_size"))


@query("select count(*) as n, sum(o_totalprice) as total from orders where o_orderkey < 0")
def agg_empty_global(t):
    return aggregate(where(t("orders"), col("o_orderkey") < 0), n=F.count(F.lit(1)), total=F.sum("o_totalprice"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def select_distinct(t):
    return project(t("orders"), "o_orderstatus", "o_orderpriority").distinct()


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def agg_having(t):
    return where(aggregate(t("orders"), "o_custkey", n=F.count(F.lit(1))), col("n") > 12)


@query("select lower(c_mktsegment) as segment, count(*) as n from customer group by lower(c_mktsegment)")
def group_ci(t):
    return aggregate(t("customer"), fold("c_mktsegment").alias("segment"), n=F.count(F.lit(1)))


@query("select years, count(*) as n from (select year(o_orderdate) - 1990 as years from orders) x group by years")
def subquery_group(t):
    return aggregate(project(t("orders"), years=F.year("o_orderdate") - 1990), "years", n=F.count(F.lit(1)))


@query("select c_mktsegment, count(*) as n from (select c_mktsegment, o_orderkey from customer, orders where c_custkey = o_custkey and o_totalprice > 100000) x group by c_mktsegment")
def subquery_join_group(t):
    inner = project(join(t("customer"), where(t("orders"), col("o_totalprice") > 100000), col("c_custkey") == col("o_custkey")), "c_mktsegment", "o_orderkey")
    return aggregate(inner, "c_mktsegment", n=F.count(F.lit(1)))


@query("select status, n from (select o_orderstatus as status, count(*) as n from orders group by o_orderstatus) x where n > 1000")
def subquery_outer_filter(t):
    return where(aggregate(t("orders"), col("o_orderstatus").alias("status"), n=F.count(F.lit(1))), col("n") > 1000)


@query("select o_orderstatus, o_totalprice, o_orderkey from orders order by o_orderstatus asc, o_totalprice desc, o_orderkey")
def sort_mixed(t):
    return sort(project(t("orders"), "o_orderstatus", "o_totalprice", "o_orderkey"), F.asc("o_orderstatus"), F.desc("o_totalprice"), "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def topk(t):
    return top(project(t("orders"), "o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("select p_partkey, cast(p_size // 7 as double) as sevens from part")
def trunc_division(t):
    return project(t("part"), "p_partkey", sevens=trunc_div("p_size", F.lit(7)))


@query("select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from orders")
def date_fields(t):
    return project(t("orders"), "o_orderkey", y=F.year("o_orderdate"), m=F.month("o_orderdate"), d=F.dayofmonth("o_orderdate"))


@query("select p_partkey, cast(p_size as double) as size from part")
def int_to_float(t):
    return project(t("part"), "p_partkey", size=col("p_size").cast("double"))


@query("select p_partkey, cast(cast(p_retailprice as float) as varchar) as price from part")
def float_text_prices(t):
    return project(t("part"), "p_partkey", price=float_text("p_retailprice"))


@query("select n_regionkey, any_value(r_name) as some_region, count(*) as n from nation, region where n_regionkey = r_regionkey group by n_regionkey")
def nongrouped_any_value(t):
    """A column that isn't grouped, in groups in which it is constant: so the result is defined."""
    wide = join(t("nation"), t("region"), col("n_regionkey") == col("r_regionkey"))
    return wide.groupBy("n_regionkey").agg(any_of_group("r_name").alias("some_region"), F.count(F.lit(1)).alias("n"))


@query("select max(c_name) as c_name, count(*) as n from customer where c_custkey = 7")
def nongrouped_global(t):
    """The same in a global aggregate."""
    return aggregate(where(t("customer"), col("c_custkey") == 7), any_of=("c_name",), n=F.count(F.lit(1)))


@query("select o_orderkey, c_name from orders, customer where o_custkey = c_custkey and o_totalprice > 300000")
def index_loop_join(t):
    return project(join_lookup(where(t("orders"), col("o_totalprice") > 300000), t("customer"), col("o_custkey") == col("c_custkey")), "o_orderkey", "c_name")


STORES: dict[tuple, IndexStore] = {}


def indexed(name: str, table: str, column: str, look, sql: str) -> None:
    """Registers a lookup in a sorted copy, which is built once a session and data folder."""

    def over(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId, sf_dir, table, column
        if key not in STORES:
            store = IndexStore(spark, scratch(spark, "index"))
            store.build(spark.read.parquet(f"{sf_dir}/{table}.parquet"), table, column, "PK" if name == "index_point" else "IDX")
            STORES[key] = store
        return look(STORES[key])

    register(name, over, sql)


indexed("index_point", "orders", "o_orderkey", lambda s: s.lookup("orders", "o_orderkey", 42).select("o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders where o_orderkey = 42")
indexed(
    "index_range", "lineitem", "l_shipdate", lambda s: s.between("lineitem", "l_shipdate", day("1996-01-01"), day("1996-02-01"), high_open=True).select("l_orderkey", "l_linenumber", "l_shipdate"),
    "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-02-01'",
)
indexed(
    "index_one_sided", "orders", "o_orderdate", lambda s: s.between("orders", "o_orderdate", day("2001-07-01")).select("o_orderkey", "o_orderdate"),
    "select o_orderkey, o_orderdate from orders where o_orderdate >= date '2001-07-01'",
)
indexed(
    "index_residual", "orders", "o_orderdate", lambda s: s.between("orders", "o_orderdate", day("2000-01-01"), low_open=True, residual=col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate"),
    "select o_orderkey, o_orderdate from orders where o_orderdate > date '2000-01-01' and o_orderstatus = 'F'",
)


def pipe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as pipe-delimited text and read back with the declared schema."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch(spark, "pipe")
    write_pipe(orders, path)
    return read_pipe(spark, path, orders.schema)


register("pipe_round_trip", pipe_round_trip, "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")

scripted("script_join_on", "select a.n_name as name_a, r.r_name as region -- one region each\nfrom nation a join region r on a.n_regionkey = r.r_regionkey;", "nation", "region")
scripted("script_subquery_no_alias", "select years, count(*) as n from (select year(o_orderdate) - 1990 as years from orders) group by years", "orders")
scripted(
    "script_group_sort", "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where (o_orderstatus = 'F' or o_orderstatus = 'O') and o_orderdate >= date '1996-01-01' group by o_orderpriority order by n desc, o_orderpriority limit 3",
    "orders",
)
scripted(
    "script_loose_group", "select n_regionkey, r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by n_regionkey", "nation", "region", loose=True,
    sql="select n_regionkey, any_value(r_name) as r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by n_regionkey",
)
scripted("script_inner_order", "select o_orderstatus, o_orderkey from (select o_orderstatus, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50) x where o_orderstatus <> 'P' order by o_orderkey", "orders")
scripted("script_where_in", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000) and c_acctbal > (select avg(c_acctbal) from customer)", "customer", "orders")
scripted("script_where_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)", "customer", "orders")
scripted(
    "script_two_levels", "select segment, n from (select segment, count(*) as n from (select c_mktsegment as segment, o_totalprice as price from customer, orders where c_custkey = o_custkey) y where price > 100000 group by segment) x where n > 10",
    "customer", "orders",
)
scripted("script_subquery_in_join", "select n_name, customers from nation join (select c_nationkey as nation, count(*) as customers from customer group by c_nationkey) c on n_nationkey = c.nation", "nation", "customer")

DECLARED = """
CREATE TABLE ORDERS (orderkey INT, custkey INT, status CHAR(1), price DECIMAL, day DATE, priority VARCHAR(15), PRIMARY KEY (orderkey), INDEX byday (day));
CREATE TABLE CUSTOMER (custkey INT, name VARCHAR(25), segment CHAR(10))
"""


def declared(name: str, text: str, sql: str, index: bool = False) -> None:
    """Registers the last query of a script whose tables are declared over pipe-delimited files, as the
    lines that it prints. With ``index``, the declared indexes are built first and used."""

    def over(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, read = scratch(spark, "declared"), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        write_pipe(read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate"), "o_orderpriority"), f"{folder}/ORDERS.dat")
        write_pipe(read("customer").select("c_custkey", "c_name", "c_mktsegment"), f"{folder}/customer.tbl")
        catalog, store = Catalog(spark, folder), None
        if index:
            list(run(spark, DECLARED, catalog))
            store = IndexStore(spark, scratch(spark, "index"))
            store.build_all(catalog)
        out = list(run(spark, f"{DECLARED}\n{text}", catalog, store=store))[-1]
        return out.select(line(out, "null").alias("line"))

    register(name, over, sql)


declared(
    "ddl_pipe_files", "select o.orderkey, name, priority, day from orders o, customer c where o.custkey = c.custkey and status = 'F' and day < date '1996-01-01'",
    "select concat_ws('|', o_orderkey, c_name, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')) as line from orders, customer where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderdate < date '1996-01-01'",
)
declared(
    "ddl_indexed_range", "select orderkey, status from orders where day >= date '1996-01-01' and day < date '1996-02-01' and status <> 'F'",
    "select concat_ws('|', o_orderkey, o_orderstatus) as line from orders where o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-02-01' and o_orderstatus <> 'F'", index=True,
)
