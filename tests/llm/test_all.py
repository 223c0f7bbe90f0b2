"""Every registered query over awkward and over empty tables, and with columns of clashing names."""

import pytest

import corpus_pipeline
from slatewing.llm import chunks, decontaminate, licenses, mixing, packing, quality, simhash, suffixes
from slatewing.llm.queries import catalogue

QUERIES, SQL = catalogue()
PER_DOCUMENT = ("op2_latent_vote", "op3_interval_tree", "op6_gear_chunks", "op8_license", "op9_context_mixing", "op10_simhash")


def test_all_ten_are_registered():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows(spark, awkward, name):
    got = QUERIES[name](spark, awkward)
    n = got.count()
    if name in PER_DOCUMENT:
        assert n == spark.read.parquet(f"{awkward}/documents.parquet").count()
        assert got.filter("doc_id is null").count() == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_over_awkward_and_empty_tables(spark, awkward, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    got = corpus_pipeline.run(spark, awkward).toPandas()
    assert {103, 104} <= set(got["doc_id"].dropna()) and 17 not in set(got["doc_id"].dropna())


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: quality.scored(d, quality.fit(d, d.sparkSession.createDataFrame([(6, 1), (14, 0)], "doc_id long, quality int"))),
        lambda d: suffixes.removed(d), lambda d: chunks.deduplicated(d), lambda d: licenses.verdicts(d), lambda d: mixing.score(d), lambda d: simhash.classes(d), lambda d: simhash.near_duplicates(d),
        lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, "no such words here at all")], "item_id long, text string")),
    ],
)
def test_clashing_names(clashing, apply):
    assert apply(clashing).count() == clashing.count()


def test_clashing_names_in_packing(clashing):
    assert packing.best_fit(clashing).filter("piece = 0").count() == clashing.count()


def test_two_thirds_of_the_rows_alike(spark, documents):
    hot = documents.unionByName(documents.filter("doc_id = 6").crossJoin(spark.range(200)).select(*documents.columns))
    assert simhash.one_of_each(hot).filter("doc_id = 6").count() == 1
    assert suffixes.removed(hot).filter("doc_id = 6 and n_removed = n_bytes").count() == 603
    assert licenses.verdicts(hot).count() == hot.count()
    assert chunks.deduplicated(hot).count() == hot.count()
    scores = mixing.score(hot).filter("doc_id = 6")
    assert scores.count() == 603 and scores.select("score", "base_score").distinct().count() == 1
    leak = hot.sparkSession.createDataFrame([(1, hot.filter("doc_id = 6").first().text, "x", 3)], "item_id long, text string, doc_id string, seed int")
    found = decontaminate.overlaps(hot, leak)
    assert found.filter("doc_id = 6").count() == 1 and decontaminate.clean(hot, leak).filter("doc_id = 6").count() == 0
    assert packing.best_fit(hot, capacity=400).filter("doc_id = 6").groupBy("bin_id").count().filter("count > 1").count() == 0
