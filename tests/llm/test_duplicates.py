"""SimHash, suffix array and chunks against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from awkward_rows import PASSAGE
from hypothesis import given, settings
from hypothesis import strategies as st

from slatewing.llm import chunks, graph, simhash, suffixes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def roots(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not words:
        return 0
    own = [xxhash.xxh64(b" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))


def test_fingerprints_and_components(spark, awkward, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [fingerprint(t) for _, t in rows]
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g].append(i)
    want = Counter((i, f"{p:016x}", min((x for x in least[g] if x is not None), default=None)) for (i, _), p, g in zip(rows, prints, group))
    assert Counter(map(tuple, simhash.op10_simhash(spark, awkward).collect())) == want


@settings(deadline=None, max_examples=30)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_some_mask_covers_any_three_bits(x, places):
    y = x
    for p in places:
        y ^= 1 << p
    assert any(x & m == y & m for m in simhash.masks(3))
    assert any(x & m == y & m for m in simhash.masks(6))


@pytest.mark.parametrize("bucket", [3, 40, 10_000])
def test_links_in_crowded_buckets(spark, bucket):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(3)]
    values = sorted({b ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(60)})
    got = simhash.near_links(spark.createDataFrame([(simhash.signed(v),) for v in values], "print long"), 3, bucket)
    at = {simhash.signed(v): i for i, v in enumerate(values)}
    found = [(at[a], at[b]) for a, b in got.collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in found)
    every = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert roots(len(values), found) == roots(len(values), every)


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (60, 61), (61, 60)] + [(200, 201 + i) for i in range(50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    want = roots(400, links)
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long"), few=few).collect()))
    assert got == {i: want[i] for i in {x for p in links for x in p if p[0] != p[1]}}
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long"), few=few).count() == 0


def test_near_duplicates_by_shingles(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for k in (1, 2, 4):
            own = list(base)
            for p in r.sample(range(120), k):
                own[p] = word()
            texts.append(" ".join(own))
    texts += [texts[0], "", None, "one", "ONE", "one two"]
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5)) for t in texts]
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    want = roots(len(texts), links)
    for bucket, easy in ((4, 2), (2048, 0)):
        monkeypatch.setattr(simhash, "EASY", easy)
        got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bucket=bucket).toPandas().sort_values("doc_id")["root"].tolist()
        assert len(set(zip(want, got))) == len(set(got)) == len(set(want))


def edited_copies(seed, kinds):
    """Texts with copies that have a fifth appended or cut off, or a block replaced."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(120)]
        at = r.randrange(20, 90)
        copies = {"append": base + [word() for _ in range(r.randint(20, 28))], "cut": base[: r.randint(98, 110)], "block": base[:at] + [word() for _ in range(7)] + base[at + 7 :]}
        texts += [" ".join(base), *(" ".join(copies[k]) for k in kinds)]
    return texts


def similar_links(texts):
    sets = [frozenset(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("kind", ["append", "cut", "block"])
def test_every_near_duplicate_is_found(spark, kind):
    texts = edited_copies(17, [kind])
    links = similar_links(texts)
    assert len(links) >= 30
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")["root"].tolist()
    want = roots(len(texts), links)
    assert len(set(zip(want, got))) == len(set(got)) == len(set(want))


def cover(texts, least):
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        own = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                own[i] += 1
                own[i + least] -= 1
        gone = np.cumsum(own)[:-1] > 0
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_removed_bytes(spark, documents, crowd):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = Counter((i, *c) for (i, _), c in zip(rows, cover([(t or "").encode() for _, t in rows], 400)))
    got = suffixes.removed(documents, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab", min_size=0, max_size=40), min_size=2, max_size=8), st.integers(0, 12))
def test_interval_scan_finds_every_repeat(texts, anchor):
    least, gram = 8, "aab"
    held = [suffixes.Suffix((t[:anchor] + gram + t[anchor:]).encode(), min(len(t), anchor), i) for i, t in enumerate(texts)]
    got = {x.who: (before, after) for x, before, after in suffixes.interval_scan(held, least)}
    groups = {(x[0].before[len(x[0].before) - b :], x[0].after[:a]): {y.who for y in x} for b, a, x in suffixes.repeat_groups_of(held, least)}
    want, strings = {}, {}
    for x in held:
        for y in held:
            if y is not x and (x.extension(y), x.prefix(y)) != (len(x.before), len(x.after)) and (x.before, x.after) != (y.before, y.after):
                left, right = x.extension(y), x.prefix(y)
                if left + right >= least:
                    before, after = want.get(x.who, (0, 0))
                    want[x.who] = max(before, left), max(after, right)
                    strings[(x.before[len(x.before) - left :], x.after[:right])] = None
    occurrences = {(b, a): {z.who for z in held if z.before.endswith(b) and z.after.startswith(a)} for b, a in strings}
    whole = {(x.before, x.after) for x in held}
    if len(whole) == len(held):  # the scan gets different segments only
        assert {k: v for k, v in groups.items() if k in occurrences} == occurrences
        assert set(groups) <= set(occurrences) | whole
        assert all(got[w][0] >= b and got[w][1] >= a for w, (b, a) in want.items())
        for w, (b, a) in got.items():
            own = [k for k, v in groups.items() if w in v]
            assert (b, a) == (max(len(k[0]) for k in own), max(len(k[1]) for k in own))


def test_groups_have_all_occurrences(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, core = noise(700), noise(450)
    texts = [noise(300) + shared + noise(200), noise(100) + shared + noise(50), "x" + core + noise(90), noise(40) + core + "y" + core, core, noise(900), None, "", noise(900)] + [noise(500)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [(t or "").encode() for t in texts]
    groups = defaultdict(set)
    for g, n, i, start in map(tuple, suffixes.repeat_groups(docs).collect()):
        groups[(g, n)].add((i, start))
    covered = [np.zeros(len(t) + 1, np.int64) for t in plain]
    for (_, n), places in groups.items():
        string = {plain[i][a : a + n] for i, a in places}
        assert len(string) == 1 and n >= 400
        string = string.pop()
        assert places == {(i, a) for i, t in enumerate(plain) for a in range(len(t)) if t.startswith(string, a)} and len(places) > 1
        for i, a in places:
            covered[i][a] += 1
            covered[i][a + n] -= 1
    want = {i: c[1] for i, c in enumerate(cover(plain, 400))}
    assert {i: int((np.cumsum(c) > 0).sum()) for i, c in enumerate(covered)} == want


def test_what_remains(spark, documents):
    rows = {r.doc_id: (r.text or "").encode() for r in documents.collect() if r.doc_id is not None}
    for r in suffixes.removed(documents).filter("doc_id > 8").collect():
        gone = list(zip(r.spans[::2], r.spans[1::2]))
        kept = b"".join(rows[r.doc_id][a:b] for a, b in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), None]))
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256 and kept.decode(errors="replace") == r.text
        assert sum(b - a for a, b in gone) == r.n_removed and len(gone) == r.n_spans


def test_anchors_are_stored_in_full_files(spark):
    """Each file costs processes that for a moment are images of the executor."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "256k")
        spark.conf.set(names[1], "-1")
        rows = spark.range(100_000).selectExpr("xxhash64(id div if(id < 100, 2, 1)) AS h", "xxhash64(id) AS s", "id AS k1", "id AS k2", "id AS place")
        got = suffixes.anchored(rows)
        assert sorted(r.k1 for r in got.select("k1").collect()) == sorted(k for k in range(100_000) if k < 100) and len(got.inputFiles()) == 1
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_pieces_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 100)
    text = bytes(random.Random(1).randbytes(1000))
    parts = list(suffixes.pieces(text, 40))
    windows = [a + i for a, p in parts for i in range(len(p) - 39)]
    assert windows == list(range(961)) and all(text[a : a + len(p)] == p for a, p in parts)


def test_chunks_resist_shifts_and_keep_characters():
    r = random.Random(2)
    text = "".join(r.choice("abc déf中g ") for _ in range(4000)).encode()
    whole = chunks.chunk_bounds(text)
    parts = {text[a:b] for a, b in zip(whole, whole[1:])}
    moved = b"inserted " + text
    bounds = chunks.chunk_bounds(moved)
    assert len([1 for a, b in zip(bounds, bounds[1:]) if moved[a:b] in parts]) >= len(parts) - 3
    for t, b in ((text, whole), (moved, bounds), (b"", [0]), (b"x", [0, 1])):
        own = chunks.chunk_bounds(t)
        assert own == b and own[-1] == len(t)
        assert b"".join(t[i:j] for i, j in zip(own, own[1:])) == t
        for i, j in zip(own, own[1:]):
            t[i:j].decode()
            assert j - i <= chunks.MOST
    assert chunks.batch_bounds([text, b"", moved]) == [whole, [0], bounds]


def test_passages_are_cut_once(spark, documents):
    got = {r.doc_id: r for r in chunks.deduplicated(documents).collect() if r.doc_id is not None and r.doc_id > 8}
    assert got[12].n_removed == 0 and got[13].n_removed > 0.6 * len(PASSAGE)
    assert all(got[100 + i].n_removed == 0 for i in range(30))
    rows = {r.doc_id: r.text for r in documents.collect()}
    assert got[12].text == rows[12] and len(got[13].text.encode()) == got[13].n_bytes - got[13].n_removed


def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Copies with many edits are alike to the original, not to each other; the pairs compared grow with the group, not with its square."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    base, texts = [word() for _ in range(150)], []
    for _ in range(300):
        own = list(base)
        for p in r.sample(range(150), r.randint(1, 5)):
            own[p] = word()
        texts.append(" ".join(own))
    links, sizes, real = similar_links(texts), [], simhash.enough
    monkeypatch.setattr(simhash, "enough", lambda pairs, *how: sizes.append(pairs.count()) or real(pairs, *how))
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")["root"].tolist()
    want = roots(len(texts), links)
    assert len(set(zip(want, got))) == len(set(got)) == len(set(want))
    assert sum(sizes) < 30 * 300 < 300 * 299 / 2 / 4  # 14 tables' forests and the rounds: linear


def chunked(rows, run_bytes=96):
    """What op6 leaves of (doc_id, text) rows with different ids, by plain loops."""
    place, cut = {}, {}
    for i, t in sorted(rows):
        b = chunks.chunk_bounds(t)
        cut[i] = [(x, y, t[x:y]) for x, y in zip(b, b[1:])]
        for x, _, c in cut[i]:
            place.setdefault(c, []).append((i, x))
    out = {}
    for i, t in rows:
        kept, run = b"", []
        for x, y, c in [*cut[i], (0, 0, None)]:
            if c is not None and len(place[c]) > 1:
                run.append((x, y, c))
                continue
            long = sum(b - a for a, b, _ in run) >= run_bytes
            kept += b"".join(z for a, _, z in run if not long or place[z][0] == (i, a))
            run = []
            kept += c or b""
        out[i] = kept
    return out


def passages(seed, n=40):
    """Random texts, some with passages of other texts."""
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdefghé ") for _ in range(k))
    shared = [noise(k) for k in (60, 130, 400, 900)]
    return [(i, noise(r.randint(0, 600)) + (r.choice(shared) if i % 3 else "") + noise(r.randint(0, 300)) + (r.choice(shared) if i % 4 == 0 else "")) for i in range(n)] + [(n, ""), (n + 1, "x")]


def test_chunks_against_plain_loops(spark):
    rows = passages(5)
    got = {r.doc_id: r for r in chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = chunked([(i, t.encode()) for i, t in rows])
    assert {i: r.text.encode() for i, r in got.items()} == want
    assert all(r.n_bytes - r.n_removed == len(want[i]) for i, r in got.items()) and sum(r.n_removed for r in got.values()) > 2000
