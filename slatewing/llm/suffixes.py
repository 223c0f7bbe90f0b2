"""Exact removal of long repeats by a common-prefix interval tree over an enhanced suffix array.

The suffix array is sparse and dealt out by content. Every window of ``least`` bytes has one anchor: of
the ``GRAM``-byte strings in it the one with the smallest hash, the leftmost of equals. Equal windows
have equal anchors at equal places, so it is enough to compare suffixes that begin at equal anchors, and
an anchor found once needs no comparison at all. An anchor's segment is the text that its windows cover.

1. One task's texts give rows (hash of the anchor, hash of the segment, place), which are counted with
   partial sums before the shuffle: segments found more than once repeat as a whole; anchors with
   several different segments remain.
2. Of those, one copy of each different segment is fetched and sorted by what follows the anchor: the
   suffix array of that anchor with its common prefixes. A stack scan goes through the common-prefix
   intervals from the longest down. Each interval keeps its suffixes in the order of what precedes the
   anchor; a run of them with a common left extension that together with the common prefix has
   ``least`` bytes, and that draws on several of the interval's children, is a maximal repeat with all
   its occurrences (``repeat_groups``). A suffix's span is the union of its groups (``repeat_spans``).
3. The spans of a text are united, cut out, and the rest is hashed.

Copies of a whole text count once before any comparison, so a large group of copies is one text. An
anchor with over ``CROWD`` different segments isn't gathered in one task: its windows are counted by
their 128-bit hash instead, which is exact as well and combines before the shuffle.

Defined results: a null text is empty; texts under ``least`` bytes keep everything; equal rows are
occurrences of each other; a null doc_id is kept. Only id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm.common import stored, table
from slatewing.llm.words import text_keys

LEAST = 400
GRAM = 128
CROWD = 20_000
PIECE = 1 << 22
BATCH = 1 << 20
ODD = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(POWERS[0]) < n:
        inverse = pow(ODD, -1, 1 << 64)
        for i, base in enumerate((ODD, inverse)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            POWERS[i] = np.cumprod(x)
    return POWERS[0][:n], POWERS[1][:n]


POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
BYTE = np.cumprod(np.full(256, 0xD1342543DE82EF95, np.uint64))


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place."""
    power, inverse = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(BYTE[x] * power[: len(x)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(x) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(x: np.ndarray, spans: list[tuple[int, int]], least: int, gram: int):
    """(text number, lo, hi, anchor, hash) of every run of windows with one anchor. ``spans`` are the
    bounds of the texts in x; lo and hi are the first and the last window's start."""
    spans = [(i, a, b) for i, (a, b) in enumerate(spans) if b - a >= least]
    if not spans:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    h = gram_hashes(x, gram)
    width = least - gram + 1
    low = np.uint64((1 << 24) - 1)
    mark = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(mark) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(mark)] = mark
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    number, begin, end = (np.array(v) for v in zip(*spans))
    count = end - begin - least + 1
    which = np.repeat(np.arange(len(count)), count)
    p = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]
    at = (np.minimum(after[p], before[p + width - 1]) & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (which[1:] != which[:-1])])
    last = np.r_[new[1:], len(p)] - 1
    return [number[which[new]], p[new], p[last], at[new], h[at[new]]]


def pieces(text: bytes, least: int):
    """Parts of a very long text that share all but their windows."""
    for a in range(0, max(1, len(text) - least + 1), PIECE):
        yield a, text[a : a + PIECE + least - 1]


def occurrences(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(h, s, k1, k2, place) of every anchor of rows (k1, k2, text); place packs lo, anchor - lo and hi - lo.
    A text that a task has just seen is passed over: that it has copies is found elsewhere."""

    def run(batches):
        from xxhash import xxh64_intdigest as digest

        seen: set = set()

        def give(part):
            x = np.frombuffer(b"".join(v[3] for v in part), np.uint8)
            ends = np.cumsum([len(v[3]) for v in part])
            bounds = [(int(e) - len(v[3]), int(e)) for v, e in zip(part, ends)]
            number, lo, hi, at, h = anchors(x, bounds, least, gram)
            joined = x.tobytes()
            s = np.fromiter((digest(joined[a : b + least], c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), at.tolist())), np.uint64, len(lo))
            offset = np.array([v[2] - b[0] for v, b in zip(part, bounds)])[number]
            place = (lo + offset) << 24 | (at - lo) << 12 | (hi - lo)
            k1, k2 = (np.array([v[i] for v in part], np.int64)[number] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (h.view(np.int64), s.view(np.int64), k1, k2, place)], names=["h", "s", "k1", "k2", "place"])

        for batch in batches:
            part, held = [], 0
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (k1, k2) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((k1, k2))
                for a, piece in pieces(text.as_py(), least):
                    part.append((k1, k2, a, piece))
                    held += len(piece)
                    if held >= BATCH:
                        yield give(part)
                        part, held = [], 0
            if part:
                yield give(part)

    return texts.mapInArrow(run, "h long, s long, k1 long, k2 long, place long")


def low_zeros(x: int) -> int:
    return (x & -x).bit_length() - 1 >> 3


class Suffix:
    """One segment: what precedes and what follows its anchor, also as numbers for fast comparison."""

    __slots__ = ("after", "before", "left", "right", "who")

    def __init__(self, segment: bytes, anchor: int, who):
        self.before, self.after, self.who = segment[:anchor], segment[anchor:], who
        self.left, self.right = int.from_bytes(self.before, "big"), int.from_bytes(self.after, "little")

    def prefix(self, other: Suffix) -> int:
        most, x = min(len(self.after), len(other.after)), self.right ^ other.right
        return min(most, low_zeros(x)) if x else most

    def extension(self, other: Suffix) -> int:
        most, x = min(len(self.before), len(other.before)), self.left ^ other.left
        return min(most, low_zeros(x)) if x else most


def stack_scan(array: list[Suffix], rank: list[int], merge) -> None:
    """The common-prefix intervals of an enhanced suffix array, the longest prefix first: merge(children,
    prefix) gets the ranks of each child of an interval and gives those of the interval."""
    stack: list[tuple[int, list[int]]] = []  # common prefix with the interval below, ranks

    def close():
        prefix, children = stack[-1][0], []
        while len(stack) > 1 and stack[-1][0] == prefix:
            children.append(stack.pop()[1])
        below, first = stack.pop()
        stack.append((below, merge([first, *reversed(children)], prefix)))

    for i, own in enumerate(array):
        prefix = array[i - 1].prefix(own) if i else -1
        while len(stack) > 1 and stack[-1][0] > prefix:
            close()
        stack.append((prefix, [rank[i]]))
    while len(stack) > 1:
        close()


def enhanced(suffixes: list[Suffix]) -> tuple[list[Suffix], list[Suffix], list[int]]:
    """The suffixes in the order of what follows; in the order of what precedes; the second's places for
    the first."""
    array = sorted(suffixes, key=lambda x: x.after)
    order = sorted(range(len(array)), key=lambda i: array[i].before[::-1])
    rank = [0] * len(array)
    for r, i in enumerate(order):
        rank[i] = r
    return array, [array[i] for i in order], rank


def repeat_groups_of(suffixes: list[Suffix], least: int):
    """(bytes before, bytes after, suffixes) of every maximal repeat of ``least`` bytes or more around one
    anchor, with all its occurrences. In each common-prefix interval, the runs of suffixes with a common
    left extension are found by a second stack scan; a run is a group if it draws on several children
    (what follows is diverse), and since no neighbour shares its whole extension, what precedes is
    diverse as well."""
    array, by_left, rank = enhanced(suffixes)
    longest = max((len(x.before) for x in suffixes), default=0)
    found = []

    def runs(members: list[int], child: list[int], prefix: int):
        change = [len(members)] * len(members)  # the next place with another child
        for i in range(len(members) - 2, -1, -1):
            change[i] = i + 1 if child[i] != child[i + 1] else change[i + 1]
        stack: list[tuple[int, int]] = []  # common extension, first place
        for i in range(1, len(members) + 1):
            left = by_left[members[i - 1]].extension(by_left[members[i]]) if i < len(members) else -1
            start = i - 1
            while stack and stack[-1][0] > left:
                extension, start = stack.pop()
                if extension + prefix >= least and change[start] < i:
                    found.append((extension, prefix, [by_left[r] for r in members[start:i]]))
            if left + prefix >= least and (not stack or stack[-1][0] < left):
                stack.append((left, start))

    def merge(children: list[list[int]], prefix: int) -> list[int]:
        if longest + prefix < least:
            return sorted(r for c in children for r in c)
        of = sorted((r, k) for k, c in enumerate(children) for r in c)
        members = [r for r, _ in of]
        runs(members, [k for _, k in of], prefix)
        return members

    stack_scan(array, rank, merge)
    return found


def interval_scan(suffixes: list[Suffix], least: int):
    """(suffix, bytes before, bytes after) of each suffix in some group of ``repeat_groups_of``: the most
    before and the most after the anchor over its groups, all of which hold the anchor, so that this is
    their union. No group is listed: where a child's suffix comes into the interval's order by what
    precedes, only its neighbours can have the longest left extension, so only those are compared."""
    array, by_left, rank = enhanced(suffixes)
    longest = max((len(x.before) for x in suffixes), default=0)
    reach: dict[int, tuple[int, int]] = {}

    def merge(children: list[list[int]], prefix: int) -> list[int]:
        a, *others = sorted(children, key=len, reverse=True)
        if longest + prefix < least:
            return sorted(r for c in children for r in c)
        for r in (r for b in others for r in b):
            k = bisect.bisect_left(a, r)
            for n in (*a[k - 1 : k], *a[k : k + 1]):
                left = by_left[r].extension(by_left[n])
                if left + prefix >= least:
                    for x in (r, n):
                        before, after = reach.get(x, (0, 0))
                        reach[x] = max(before, left), max(after, prefix)
            a.insert(k, r)
        return a

    stack_scan(array, rank, merge)
    return [(by_left[r], before, after) for r, (before, after) in reach.items()]


def cut_segments(requests: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(h, s, k1, k2, start, anchor, segment) for the asked-for places, from any copy of each text."""
    wanted = requests.groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.collect_set(F.struct("h", "s", "place")).alias("x"))
    rows = texts.join(wanted, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).select("k1", "k2", "text", F.col("x.h").alias("h"), F.col("x.s").alias("s"), F.col("x.place").alias("place"))

    def run(batches):
        last = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if (k1, k2) == last:
                    continue
                last = k1, k2
                text = batch.column(2)[i].as_py()
                h, s, place = (batch.column(c)[i].as_py() for c in (3, 4, 5))
                for a, b, p in zip(h, s, place):
                    lo, anchor, more = p >> 24, p >> 12 & 4095, p & 4095
                    out.append((a, b, k1, k2, lo, anchor, text[lo : lo + more + least]))
                if len(out) > 5_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    def packed(out):
        columns = list(zip(*out))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["h", "s", "k1", "k2", "start", "anchor", "segment"])

    return rows.mapInArrow(run, "h long, s long, k1 long, k2 long, start long, anchor int, segment binary")


SPANS = "k1 long, k2 long, start long, stop long"


def by_anchor(segments: DataFrame, rows_of, schema: str) -> DataFrame:
    """rows_of(anchor's hash, suffixes) for every anchor with several segments; an anchor's rows stream
    by in order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        current, held, last, out = None, [], None, []

        def give():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
            out.clear()
            return batch

        for batch in batches:
            h, s, k1, k2, start, anchor = (c.to_pylist() for c in batch.columns[:6])
            for i, segment in enumerate(batch.column(6)):
                if h[i] != current:
                    if len(held) > 1:
                        out += rows_of(current, held)
                    current, held, last = h[i], [], None
                if s[i] != last:  # a copy of the segment may have come twice
                    held.append(Suffix(segment.as_py(), anchor[i], (k1[i], k2[i], start[i] + anchor[i], s[i])))
                    last = s[i]
                if len(out) > 5_000:
                    yield give()
        if len(held) > 1:
            out += rows_of(current, held)
        if out:
            yield give()

    return segments.repartition("h").sortWithinPartitions("h", "s").mapInArrow(run, schema)


def scanned(segments: DataFrame, least: int) -> DataFrame:
    """Spans found by the interval scan of every anchor's segments."""

    def rows_of(_, held):
        return [(x.who[0], x.who[1], x.who[2] - before, x.who[2] + after) for x, before, after in interval_scan(held, least)]

    return by_anchor(segments, rows_of, SPANS)


def counted(segments: DataFrame, least: int) -> DataFrame:
    """Spans of crowded anchors: windows that are found in several segments, by their hash."""

    def run(batches):
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            h, _, k1, k2, start, _ = (c.to_pylist() for c in batch.columns[:6])
            for i, segment in enumerate(batch.column(6)):
                segment = segment.as_py()
                n = len(segment) - least + 1
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (h[i], k1[i], k2[i])] + [pa.array(range(start[i], start[i] + n), pa.int64()), pa.array([digest(segment[j : j + least]) for j in range(n)], pa.binary())], names=["h", "k1", "k2", "start", "window"])

    rows = segments.dropDuplicates(["h", "s"]).mapInArrow(run, "h long, k1 long, k2 long, start long, window binary")
    again = rows.groupBy("h", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "window")
    return rows.join(again, ["h", "window"]).select("k1", "k2", "start", (F.col("start") + least).alias("stop"))


def anchored(rows: DataFrame) -> DataFrame:
    """(h, s, n, m, k1, k2, place): the segments of all anchors that occur more than once. n: times the
    segment occurs in different texts or places, m: different segments of the anchor; one place of each.
    They are few beside the rows, so they are dealt to files of full size: to write a file on a local disk
    Hadoop starts several processes (chmod), each of which for a moment is an image of the whole executor."""
    one = rows.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at"))
    segments_of = one.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most")).filter((F.col("m") > 1) | (F.col("most") > 1)).select(F.col("h").alias("anchor_hash"), "m")
    return stored(one.join(segments_of, F.col("h") == F.col("anchor_hash")).filter((F.col("n") > 1) | (F.col("m") > 1)).select("h", "s", "n", "m", "at.*").hint("rebalance"), "anchors")


def repeat_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, start, stop): stretches of the texts that repeat elsewhere; they may overlap."""
    long = texts.filter(F.octet_length("text") >= least).select("k1", "k2", "text")
    rows = occurrences(long, least, gram)  # made twice: that costs less than storing them
    groups = anchored(rows)

    lo = F.shiftright("place", 24)
    again = groups.filter("n > 1").select("h", "s")
    whole = rows.join(again, ["h", "s"], "left_semi").select("k1", "k2", lo.alias("start"), (lo + F.col("place").bitwiseAND(4095) + least).alias("stop"))
    requests = groups.filter("m > 1")
    few = scanned(cut_segments(requests.filter(F.col("m") <= crowd), long, least), least)
    many = requests.filter(F.col("m") > crowd)
    if many.isEmpty():
        return whole.unionByName(few)
    return whole.unionByName(few).unionByName(counted(stored(cut_segments(many, long, least), "crowded"), least))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, text as bytes)"""
    clean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return clean.select("doc_id", *text_keys("text"), F.col("text").cast("binary").alias("text"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(group, n_bytes, doc_id, start): every maximal repeat of ``least`` bytes or more with all its
    occurrences, one row each; ``group`` is a 64-bit digest of the repeated bytes. Repeats are maximal
    within the surroundings of their anchor (its segment): one that is longer than these gives
    overlapping groups, one for each anchor in it. All segments of an anchor are scanned in one task."""
    texts = keyed(docs, id_col, text_col)
    long = texts.filter(F.octet_length("text") >= least).select("k1", "k2", "text")
    rows = occurrences(long.dropDuplicates(["k1", "k2"]), least, gram)
    groups = anchored(rows)

    def rows_of(h, held):
        from xxhash import xxh64_intdigest as digest

        out = []
        for before, after, members in repeat_groups_of(held, least):
            x = members[0]
            group = digest(x.before[len(x.before) - before :] + x.after[:after])
            group -= (group >> 63) << 64
            out += [(h, y.who[3], group, before, after) for y in members]
        return out

    scan = by_anchor(cut_segments(groups.filter("m > 1"), long, least), rows_of, "h long, s long, group long, before long, after long")
    copies = texts.select("doc_id", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    # A segment that occurs several times, or whose text does, is a group by itself.
    number = texts.filter(F.octet_length("text") >= least).groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.count(F.lit(1)).alias("copies"))
    at = rows.withColumn("anchor", F.shiftright("place", 12).bitwiseAND(4095)).withColumn("lo", F.shiftright("place", 24)).withColumn("size", F.col("place").bitwiseAND(4095) + least)
    counted_at = at.join(number, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).drop("c1", "c2")
    again = counted_at.groupBy("h", "s").agg(F.sum("copies").alias("n"), F.first("anchor").alias("before"), F.first("size").alias("size")).filter("n > 1")
    alone = again.select("h", "s", F.xxhash64("h", "s").alias("group"), F.col("before").cast("long").alias("before"), (F.col("size") - F.col("before")).cast("long").alias("after"))
    placed = stored(scan.unionByName(alone), "groups").join(at.select("h", "s", "k1", "k2", (F.col("lo") + F.col("anchor")).alias("middle")), ["h", "s"])
    found = placed.join(copies, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    return found.select("group", (F.col("before") + F.col("after")).alias("n_bytes"), "doc_id", (F.col("middle") - F.col("before")).alias("start")).distinct()


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first and last + 1 byte of each
    removed run in turn), text (what remains, as UTF-8; where a run begins or ends inside a character,
    U+FFFD stands for the rest of it, while kept_sha256 is that of the very bytes)."""
    texts = keyed(docs, id_col, text_col)
    found = repeat_spans(texts, least=least, crowd=crowd)
    spans = found.groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.collect_set(F.struct("start", "stop")).alias("x"))
    copies = texts.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = texts.join(copies, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    rows = rows.select("doc_id", "text", F.col("copies").isNotNull().alias("again"), F.col("x.start").alias("start"), F.col("x.stop").alias("stop"))

    def run(batches):
        for batch in batches:
            out, lists = [], []
            for text, again, start, stop in zip(*batch.columns[1:]):
                text = text.as_py()
                own = [(0, len(text))] if again.as_py() and len(text) >= least else united(list(zip(start.as_py() or (), stop.as_py() or ())))
                cuts = [0, *(x for pair in own for x in pair), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if own else text
                out.append((len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
                lists.append(cuts[1:-1])
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:4], pa.array(lists, pa.list_(pa.int64())), made[4]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, text string")


def op3_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what its repeats of 400 bytes are and what remains without them."""
    return removed(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op3_interval_tree": op3_interval_tree}
