"""Each stage of the pipeline against brute force, over what the stage before has kept."""

import random

import pytest
from awkward_rows import prose
from test_duplicates import chunked, roots, similar_links
from test_models import brute_vote, packed_well
from test_native import LOWER, WORD, brute_overlaps

import corpus_pipeline
from slatewing.llm import packing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(77)
    items = [prose(3000 + i, 25) for i in range(4)]
    passage = prose(4000, 90)
    texts = []
    for i in range(60):
        words = prose(i, 90 + i).split()
        if i % 6 == 1:
            words = words[:20] + passage.split() + words[20:]
        if i % 9 == 2:
            words += items[i % 4].split()
        texts.append(" ".join(words))
        if i % 5 == 0:
            words[r.randrange(len(words))] = "edited"
            texts += [" ".join(words), texts[-1]]
    texts += [("BUY NOW!! " * 30 + prose(900 + i, 3).upper()) for i in range(20)]
    labels = [(i, int(not t.startswith("BUY")), 0) for i, t in enumerate(texts) if i % 2]
    base = tmp_path_factory.mktemp("stages")
    for name, rows, schema in (
        ("documents", [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{base}/{name}.parquet")
    return f"file://{base}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("labels", "benchmark"))
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    model, before = quality.fit(docs, labels), rows(docs)
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    got = rows(kept)
    assert got == {i: t for i, t in before.items() if brute_vote(model, t) >= 0.5}
    assert not any(t.startswith("BUY") for t in got.values()) and len(got) >= 80

    ids = sorted(got)
    group = roots(len(ids), similar_links([got[i] for i in ids]))
    kept = corpus_pipeline.drop_near_duplicates(spark, kept, folder)
    one = rows(kept)
    assert one == {ids[g]: got[ids[g]] for g in set(group)} and len(one) < len(got)

    kept = corpus_pipeline.cut_repeats(spark, kept, folder)
    cut = rows(kept)
    assert {i: t.encode() for i, t in cut.items()} == chunked([(i, t.encode()) for i, t in one.items()])
    assert all(r.n_chars == len(r.text) for r in kept.collect()) and cut != one

    kept = corpus_pipeline.drop_leaks(spark, kept, folder)
    clean, asked = rows(kept), [words(r.text) for r in items.collect()]
    assert clean == {i: t for i, t in cut.items() if not any(brute_overlaps(words(t), x) for x in asked)} and len(clean) < len(cut)
    assert kept.columns == docs.columns

    rows_of = [r.asDict() for r in corpus_pipeline.pack(spark, kept, folder).collect()]
    assert packed_well(rows_of, [r.asDict() for r in kept.collect()], packing.CAPACITY)
    assert sorted(r["doc_id"] for r in rows_of) == sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
