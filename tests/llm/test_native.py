"""License scan and decontamination against brute force; neither may run Python on the executors."""

import random
import re

from awkward_rows import ITEM, prose

from slatewing.llm import decontaminate, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_phrases(spark):
    r = random.Random(4)
    vocabulary = "gnu general public license apache cc by mit the MIT License, BY-cc".split()
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["CC BY-NC 4.0, cc\nby", None, "", "mit license mit license", "gnu general public licenses"]
    got = {r.doc_id: r for r in licenses.verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").translate(LOWER))
        places = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_notices_with_changes(spark):
    text = "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software"
    r = licenses.verdicts(spark.createDataFrame([(1, text), (2, "free of charge to nobody")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].score < 1 and "mit-notice" in r[0].labels and r[0].n_base == 0 and r[1].labels == ""


def brute_labels(text):
    """Labels and score by the definition: votes on diagonals, windows of diagonals, alignment in order."""
    words = WORD.findall((text or "").translate(LOWER))
    labels, score = set(), 0.0
    for _, t, label, base, k, slack in licenses.template_list(licenses.PHRASES, (*licenses.TEMPLATES, *licenses.BODIES)):
        if base:
            if any(words[p : p + len(t)] == t for p in range(len(words))):
                labels.add(label)
                score = 1.0
            continue
        votes = {}
        for p in range(len(words) - k + 1):
            for q in range(len(t) - k + 1):
                if words[p : p + k] == t[q : q + k]:
                    votes.setdefault(p - q, set()).add(q)
        for d in votes:
            if len(set().union(*(v for e, v in votes.items() if d <= e <= d + slack))) < licenses.VOTES * (len(t) - k + 1):
                continue
            equal, begin, end = 0, None, 0
            for i, x in enumerate(t):
                at = next((p for p in range(max(d + i, end, 0), min(d + i + slack, len(words) - 1) + 1) if words[p] == x), None)
                if at is not None:
                    equal, begin, end = equal + 1, at if begin is None else begin, at + 1
            share = equal / (len(t) + end - begin - equal)
            score = max(score, share)
            if share >= licenses.COVER:
                labels.add(label)
    return ",".join(sorted(labels)), round(score, 9)


def test_labels_of_the_method(spark):
    r = random.Random(21)
    notice = licenses.TEMPLATES[9][0].split()
    torn = " ".join(f"{a} {b} zz {b}" for a, b in zip(notice, notice[1:]))
    texts = [" ".join(notice), torn, "all rights zz rights reserved", "All rights reserved.", licenses.BODIES[0][0].upper(), "x " * 30 + licenses.BODIES[1][0], None, "", "the software is provided as is"]
    for text, _ in (*licenses.TEMPLATES, *licenses.BODIES):
        for kind in range(3):
            own = text.split()
            for _ in range(1 + len(own) // 12):
                p = r.randrange(len(own))
                own[p : p + 1] = [["changed"], [], [own[p], "inserted"]][kind]
            texts.append(prose(r.randrange(99), 6) + " " + " ".join(own) + " " + prose(r.randrange(99), 6))
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert got[0] == ("mit-notice", 1.0) and got[1][0] == "" and got[2][0] == "" and got[3] == ("all-rights-reserved", 1.0) and "mit-text" in got[4][0]


def test_leaks(spark, awkward):
    words = ITEM.split()
    swapped = [w if i % 9 else "other" for i, w in enumerate(words)]
    texts = [f"{prose(1, 50)} {ITEM} {prose(2, 50)}", f"{prose(3, 10)} {' '.join(swapped)}", " ".join(words[8:21]), " ".join(words[:6]), prose(4, 500), ITEM.upper().replace(" ", " ,\n"), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.read.parquet(f"{awkward}/benchmark.parquet")
    found = decontaminate.overlaps(docs, items)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (5, 1)}
    assert got[(0, 1)].score == len(words) and got[(0, 1)].first_word == 50 and got[(2, 1)].first_word == -8
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 6, 7]
    assert not re.search("Python|Pandas|Arrow", plan(found)) and not re.search("Python|Pandas|Arrow", plan(licenses.verdicts(docs)))


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"{prose(500 + i, 30)} {t}") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PART", 700)
    got = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(30)]


def test_any_two_substitutions_are_found(spark):
    item = prose(77, 13).split()
    texts = []
    for a in range(13):
        for b in range(a):
            own = list(item)
            own[a] = own[b] = "changed"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id for r in decontaminate.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    # Nine more matches than mismatches are asked for in one stretch, so all that keep it must be found.
    want = set()
    for i, t in enumerate(texts):
        marks, best, now = [1 if x == y else -1 for x, y in zip(t.split(), item)], 0, 0
        for m in marks:
            now = max(0, now + m)
            best = max(best, now)
        if best >= decontaminate.LEAST:
            want.add(i)
    assert found == want


def brute_overlaps(words, item):
    """Best score (then first place) over the diagonals on which some seed of both is equal."""
    seeds = lambda ws: [(k, p, tuple(ws[p + i] for i, c in enumerate(m) if c == "1")) for k, m in enumerate(decontaminate.MASKS) for p in range(len(ws) - len(m) + 1)]
    at = {}
    for k, q, s in seeds(item):
        at.setdefault((k, s), []).append(q)
    lines = {p - q for k, p, s in seeds(words) for q in at.get((k, s), ())}
    best = None
    for d in lines:
        top = now = 0
        for q in range(max(0, -d), min(len(item), len(words) - d)):
            now = max(0, now + (1 if words[d + q] == item[q] else -1))
            top = max(top, now)
        if top >= decontaminate.LEAST:
            best = max(best or (top, -d), (top, -d))
    return best and (best[0], -best[1])


def test_overlaps_of_repetitive_texts(spark):
    r = random.Random(12)
    texts = ["a " * 60, "a b " * 30, "a b c " * 25, " ".join(r.choice("ab") for _ in range(80)), "x " * 5 + "a b c d e f g h i j k l", " ".join(r.choice("abc") for _ in range(120)), "a " * 30 + "b " * 30, prose(6, 40)]
    items = ["a " * 40, "a b " * 12, "b " * 10 + "a " * 20, "a b c d e f g h i j k l", " ".join(r.choice("abc") for _ in range(30)), " ".join(r.choice("ab") for _ in range(40))]
    want = {(i, j): b for i, t in enumerate(texts) for j, x in enumerate(items) if (b := brute_overlaps(t.split(), x.split()))}
    found = decontaminate.overlaps(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.score, r.first_word) for r in found.collect()} == want


def test_one_word_five_thousand_times(spark):
    import time

    docs = spark.createDataFrame([(1, "junk " * 5000), (2, prose(5, 60))], "doc_id long, text string")
    began = time.time()
    found = [(r.doc_id, r.score, r.first_word) for r in decontaminate.overlaps(docs, spark.createDataFrame([(1, "junk " * 5000)], "item_id long, text string")).collect()]
    assert found == [(1, 5000, 0)] and time.time() - began < 60


def test_huge_items_are_not_broadcast(spark, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"{prose(500 + i, 30)} {t}") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PART", 30)
    monkeypatch.setattr(decontaminate, "MASKS", ("111111",))
    got = decontaminate.overlaps(docs, spark.createDataFrame(items[:3], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(3)]
