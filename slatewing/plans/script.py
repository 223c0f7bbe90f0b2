"""Scripts of CREATE TABLE and SELECT statements, with or without semicolons between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from slatewing.sources.catalog import Catalog
from slatewing.sources.ddl import parse_create
from slatewing.sources.index import IndexStore

TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_]\w*|[();]", re.S)
#: After these words a SELECT goes on with the same statement.
JOINING = {"UNION", "ALL", "DISTINCT", "EXCEPT", "INTERSECT", "MINUS", "AS"}
#: A statement that begins so has its first SELECT still to come.
LEADING = {"WITH", "INSERT", "EXPLAIN"}


def split(text: str) -> list[str]:
    """The statements. A new one begins after a ``;`` and at a CREATE or SELECT outside parentheses,
    texts and comments, unless that SELECT goes on with the statement before. Comments are dropped."""
    out: list[str] = []
    clean: list[str] = []
    at, depth, before, owed = 0, 0, "", False

    def close():
        if (done := "".join(clean).strip()):
            out.append(done)
        clean.clear()

    for m in TOKEN.finditer(text):
        clean.append(text[at : m.start()])
        at, token = m.end(), m[0]
        word = token.upper()
        if token.startswith(("--", "/*")):
            clean.append(" ")
            continue
        if token == ";" and depth == 0:
            close()
            before, owed = "", False
            continue
        if depth == 0 and (word == "CREATE" or word in LEADING or (word == "SELECT" and before not in JOINING and not owed)) and "".join(clean).strip():
            if not (word in LEADING and before):
                close()
        if word in LEADING and depth == 0:
            owed = True
        elif word == "SELECT" and depth == 0:
            owed = False
        depth += (token == "(") - (token == ")")
        clean.append(token)
        before = word
    clean.append(text[at:])
    close()
    return out


def select_list(statement: str) -> tuple[str, list[str], str]:
    """What comes before the outer select list, its items, and the rest from FROM on."""
    depth, begin, cuts = 0, None, []
    for m in re.finditer(TOKEN.pattern + r"|,", statement, re.S):
        word = m[0].upper()
        if depth == 0 and word == "SELECT" and begin is None:
            begin = m.end()
            cuts = [begin]
        elif depth == 0 and begin is not None and word in {",", "FROM"}:
            cuts.append(m.start())
            if word == "FROM":
                break
            cuts.append(m.end())
        depth += (word == "(") - (word == ")")
    items = [statement[i:j].strip() for i, j in zip(cuts[::2], cuts[1::2])]
    return statement[:begin], items, statement[cuts[-1] :]


def select(spark: SparkSession, statement: str, loose: bool = False) -> DataFrame:
    """One query. With ``loose``, a column of the outer select list that is neither grouped nor
    aggregated gives some value of its group instead of an error."""
    while True:
        try:
            return spark.sql(statement)
        except AnalysisException as e:
            if not loose or e.getCondition() != "MISSING_AGGREGATION":
                raise
            name = e.getMessageParameters()["expression"].strip('"').rpartition(".")[2]
            head, items, tail = select_list(statement)
            changed = [f"any_value({x}) AS {name}" if x.rpartition(".")[2].lower() == name.lower() else x for x in items]
            if changed == items:
                raise
            statement = f"{head} {', '.join(changed)} {tail}"


#: A column of a condition that is compared with something, as the optimizer writes it.
COMPARED = re.compile(r"`?(\w+)`? (?:=|>=|<=|>|<) ")


def ranges(df: DataFrame) -> Iterator[tuple[str, list[str]]]:
    """The file path of each filtered scan of a query, and the columns that its filter compares, in order."""

    def walk(node):
        if node.nodeName() == "Filter" and (child := node.child()).nodeName() == "LogicalRelation":
            for path in re.findall(r"[\w+.-]+:/[^\s,\]\)]+", child.relation().location().rootPaths().mkString(" ")):
                yield path, list(dict.fromkeys(COMPARED.findall(node.condition().sql())))
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    yield from walk(df._jdf.queryExecution().optimizedPlan())


def through_indexes(spark: SparkSession, df: DataFrame, statement: str, loose: bool, catalog: Catalog, store: IndexStore) -> DataFrame:
    """The query once more with each declared table whose filter compares an indexed column read from
    that index, a sorted copy of the table, whose files' statistics skip what the filter leaves out."""
    swapped = []
    for path, columns in ranges(df):
        name = next((n for n, p in catalog.paths.items() if path.rstrip("/").endswith(p.rstrip("/").split(":", 1)[-1].lstrip("/"))), None)
        table = catalog.tables.get(name)
        found = next((x for c in columns if table and any(c.lower() == k.lower() for keys in table.keys.values() for k in keys) and (x := store.choose(table.name, c))), None)
        if found:
            spark.read.parquet(found).createOrReplaceTempView(name)
            swapped.append(name)
    if not swapped:
        return df
    try:
        return select(spark, statement, loose)
    finally:
        for name in swapped:
            catalog.view(name)


def run(spark: SparkSession, text: str, catalog: Catalog, loose: bool = False, store: IndexStore | None = None) -> Iterator[DataFrame]:
    """Registers each declared table and gives the result of each query, in order. Declarations stay
    for later scripts over the same catalog. With a ``store``, filters on indexed columns use its indexes."""
    for statement in split(text):
        if re.match(r"create\s+table\b", statement, re.I):
            catalog.declare(parse_create(statement))
        else:
            df = select(spark, statement, loose)
            yield through_indexes(spark, df, statement, loose, catalog, store) if store else df
