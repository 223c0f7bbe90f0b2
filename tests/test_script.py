import io

import pytest

from slatewing import cli
from slatewing.plans.script import run, select_list, split
from slatewing.sources.catalog import Catalog

PLAYERS = "create table PLAYERS(ID string, FIRSTNAME string, LASTNAME string, FIRSTSEASON int, LASTSEASON int, WEIGHT int, BIRTHDATE date)"
ROWS = """p1|Ada|Bo|1990|1999|200|1968-6-24
p1|Ada|Bo|1990|1999|200|1968-6-24
p2|Cy|Dee|1969|1971|180|1947-04-16
p3|Eve||1969|1980||1945-01-02"""
PERSON = "create table personInfo(id int, first_name string, last_name string, Gender string, age int, State string)"
PEOPLE = """1|Ann|Lee|Female|30|CO
2|Bob|Ray|Male|45|RI
3|Cat| Poe|Female|52|MO
6|Ruby||Male|45|RI"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "players.DAT").write_text(ROWS)
    (tmp_path / "PersonInfo.tbl").write_text(PEOPLE + "\n")
    return str(tmp_path)


def last(spark, folder, text, loose=False):
    return [tuple(r) for r in list(run(spark, text, Catalog(spark, f"file://{folder}"), loose))[-1].collect()]


def test_statements_are_split_with_and_without_semicolons():
    assert split("create table a(x int)\nselect x from a") == ["create table a(x int)", "select x from a"]
    assert split("create table a(x int); select ';' as c from a; -- the end") == ["create table a(x int)", "select ';' as c from a"]
    assert split("select a from (select b as a from t) create table u(y int) select 1 union all select 2") == ["select a from (select b as a from t)", "create table u(y int)", "select 1 union all select 2"]
    assert split("with q as (select 1 as a) select a from q select 2") == ["with q as (select 1 as a) select a from q", "select 2"]
    assert split("-- only a comment\n") == []
    assert split("select 'create table' /* select */ from a") == ["select 'create table'   from a"]


def test_select_list():
    assert select_list("select a, f(b, c) as d from (select x from y)")[1] == ["a", "f(b, c) as d"]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("select FIRSTNAME, LASTNAME from PLAYERS where WEIGHT > 150 and BIRTHDATE >= DATE('1960-01-1')", [("Ada", "Bo")] * 2),
        ("select FIRSTSEASON, count(*) from PLAYERS group by FIRSTSEASON", [(1969, 2), (1990, 2)]),
        ("select ID, LASTSEASON - FIRSTSEASON as years from PLAYERS where LASTSEASON - FIRSTSEASON > 9", [("p3", 11)]),
        ("select avg(WEIGHT), count(WEIGHT), count(distinct ID) from PLAYERS", [(580 / 3, 3, 3)]),
        ("select years, count(*) from (select LASTSEASON - FIRSTSEASON as years from PLAYERS) group by years", [(2, 1), (9, 2), (11, 1)]),
        ("select P1.ID, P2.ID from PLAYERS P1 join PLAYERS P2 on P1.WEIGHT > P2.WEIGHT", [("p1", "p2")] * 2),
        ("select P1.* from PLAYERS P1 where P1.LASTNAME is null", [("p3", "Eve", None, 1969, 1980, None)]),
    ],
)
def test_queries_over_pipe_files(spark, folder, query, want):
    got = last(spark, folder, f"{PLAYERS}\n{query}")
    if "P1.*" in query:
        got = [r[:6] for r in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blanks_and_empty_fields(spark, folder):
    assert sorted(last(spark, folder, f"{PERSON} select id, last_name from personinfo where State = 'MO' or id = 6")) == [(3, " Poe"), (6, None)]


def test_loose_grouping(spark, folder):
    text = f"{PERSON} select State, age, count(*) as n from personInfo group by State"
    with pytest.raises(Exception, match="MISSING_AGGREGATION"):
        last(spark, folder, text)
    assert ("RI", 45, 2) in last(spark, folder, text, loose=True)


def test_a_missing_file_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError):
        last(spark, folder, "create table nowhere(x int) select x from nowhere")


def test_command_line(spark, folder, tmp_path):
    script = tmp_path / "q.sql"
    script.write_text(f"{PERSON} select State, count(*) as n from personInfo group by State order by State")
    out = io.StringIO()
    assert cli.main(["--data", folder, str(script)], out) == 0
    assert out.getvalue() == "CO|1\nMO|1\nRI|2\n"
    schema = tmp_path / "s.sql"
    schema.write_text("create table personInfo(id int, first_name string, last_name string, Gender string, age int, State string, primary key(id), index by_state(State))")
    out = io.StringIO()
    assert cli.main(["--build", "--data", folder, "--index", f"{tmp_path}/ix", str(schema)], out) == 0
    assert [x.rpartition("/")[2] for x in out.getvalue().split()] == ["PERSONINFO_ID_PK", "PERSONINFO_STATE_IDX"]


def test_filters_use_a_declared_index(spark, folder, tmp_path):
    from slatewing.sources.index import IndexStore

    declared = PLAYERS.replace("BIRTHDATE date)", "BIRTHDATE date, primary key(ID), index seasons (FIRSTSEASON))")
    catalog, store = Catalog(spark, f"file://{folder}"), IndexStore(spark, f"file://{tmp_path}/index")
    list(run(spark, declared, catalog))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles())
    query = "select ID, LASTNAME from PLAYERS where FIRSTSEASON >= 1980 and WEIGHT > 100"
    before = next(run(spark, query, catalog, store=store))
    assert "PLAYERS_FIRSTSEASON_IDX" not in plan(before)
    assert len(store.build_all(catalog)) == 2
    got = next(run(spark, query, catalog, store=store))
    assert "PLAYERS_FIRSTSEASON_IDX" in plan(got) and sorted(got.collect()) == sorted(before.collect()) == [("p1", "Bo")] * 2
    got = next(run(spark, "select p.ID from PLAYERS p join PLAYERS q on p.ID = q.ID where p.ID = 'p3'", catalog, store=store))
    assert "PLAYERS_ID_PK" in plan(got) and [tuple(r) for r in got.collect()] == [("p3",)]
    # Without a filter on an indexed column, and after a query by index, the table itself is read.
    assert "_IDX" not in plan(next(run(spark, "select ID from PLAYERS where WEIGHT > 1", catalog, store=store)))


def test_keys_of_several_columns_are_reported():
    from slatewing.sources.ddl import parse_create

    with pytest.warns(UserWarning, match="a, b"):
        assert parse_create("create table t(a int, b int, primary key (a, b))").keys == {}
