"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: the majority of each bit over the XXH64 values of all word shingles, repeats included.
Tables: a fixed map sends the 64 bit positions to vectors of F2^(r+1), and each vector v keeps the
positions not orthogonal to it. Any r differing positions leave some nonzero v orthogonal to all of
them, so two fingerprints at distance r or less agree on all kept bits of some table: the 2^(r+1)-2
tables miss no pair within the radius, and each keeps 32 bits.

Work is on distinct fingerprints, so a group of copies of any size is one node. A bucket over
``BUCKET`` fingerprints is split again by the same masks over the bits that it does not fix: pairs
within the radius still meet, and what a twice-masked bucket leaves open bounds its size. In a bucket
the links are verified in blocks and only a spanning forest leaves it, never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal rows
give equal rows; a null doc_id is kept and is no component's id unless the component has no other. An
empty table gives an empty result. Only the named columns of the input are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.llm.common import DOC_COLUMNS, LOWER_ASCII, settle, stored, table
from slatewing.llm.graph import components

BUCKET = 2048
SMALL = 16
#: Shingles that a task packs at once, and that a part of their range has on average.
PACKED, PART_SHINGLES = 1 << 22, 1_500_000
#: Pairs of texts a row of a shared shingle that are compared at once, and rounds to get there.
EASY, ROUNDS = 2, 6
#: A byte's eight bits spread over the eight bytes of a word, for sums of up to 255 of them.
SPREAD = np.array([int.from_bytes(bytes((b >> k) & 1 for k in range(8)), "little") for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes | None, k: int) -> list[int]:
    """XXH64 (seed 42) of every k-word shingle of the lower-cased text."""
    from xxhash import xxh64_intdigest as xx

    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xx(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    return [xx(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``sizes`` values (zero for an empty run)."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    parts = -(-n // 255)
    first = np.cumsum(n) - n
    part_of = np.repeat(np.arange(len(n)), parts)
    within = np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = first[part_of] + within * 255
    spread = SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, starts, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(sums.astype(np.int64), np.cumsum(parts) - parts, axis=0)
    bits = (counts * 2 > n[:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            prints, hashes, sizes, held = [], [], [], 0
            texts = batch.column(1)
            for i in range(len(texts)):
                own = shingle_hashes(texts[i].as_py(), shingle)
                hashes.append(np.array(own, np.uint64))
                sizes.append(len(own))
                held += len(own)
                if held > 200_000 or i == len(texts) - 1:
                    prints.append(majority(np.concatenate(hashes), np.array(sizes)))
                    hashes, sizes, held = [], [], 0
            values = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, print long")


def masks(radius: int, bits: int = (1 << 64) - 1) -> list[int]:
    """The covering masks over the set positions of ``bits``, as unsigned numbers. Positions get the
    vectors of F2^(r+1) with the first coordinate 1, in turn (an odd step spreads them): the masks are words of a first-order
    Reed-Muller code, and each keeps half of the positions (if their number is a multiple of 2^r). The
    one that would keep all is left out: it isn't orthogonal to any of those vectors."""
    size = 1 << radius
    places = [i for i in range(64) if bits >> i & 1]
    return [sum(1 << p for i, p in enumerate(places) if ((size | i * 45 % size) & v).bit_count() & 1) for v in range(1, 2 * size) if v != size]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(prints: np.ndarray, known: np.ndarray, radius: int):
    """Links (pairs of positions) that connect what the radius connects, given that rows with the same
    ``known`` value are connected already."""
    left = np.arange(len(prints))
    while len(left) > 1:
        same = known[left] == known[left[0]]
        queue, left = left[same].tolist(), left[~same]
        while queue and len(left):
            at = queue.pop()
            near = left[np.bitwise_count(prints[left] ^ prints[at]) <= radius]
            if len(near):
                roots, one = np.unique(known[near], return_index=True)
                for b in near[one].tolist():
                    yield at, b
                joined = np.isin(known[left], roots)
                queue += left[joined].tolist()
                left = left[~joined]


def verified(rows: DataFrame, radius: int, bucket: int | None) -> DataFrame:
    """Links (a, b) inside the buckets of rows (keys..., known, print); a bucket's rows stream by in
    order. A bucket over the limit gives a row with its keys and null links instead, and isn't held."""
    keys = [c for c in rows.columns if c not in ("known", "print")]

    def links(cells: np.ndarray):
        """For whole buckets: small ones by shifted comparison, larger ones by a forest."""
        edge = np.flatnonzero(np.r_[True, (cells[:-2, 1:] != cells[:-2, :-1]).any(axis=0)])
        size = np.diff(np.r_[edge, cells.shape[1]])
        known, prints, group = cells[-2], cells[-1].copy().view(np.uint64), np.repeat(np.arange(len(size)), size)
        small = np.repeat(size <= SMALL, size)
        most = int(size[size <= SMALL].max(initial=0))
        a, b = [], []
        for d in range(1, most):
            near = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]) & (known[d:] != known[:-d]))
            near = near[np.bitwise_count(prints[near + d] ^ prints[near]) <= radius]
            a.append(prints[near])
            b.append(prints[near + d])
        over = size > (bucket or len(prints))
        for e, n in zip(edge[(size > SMALL) & ~over], size[(size > SMALL) & ~over]):
            pairs = np.array(list(spanning(prints[e : e + n], known[e : e + n], radius)), np.int64).reshape(-1, 2)
            a.append(prints[e + pairs[:, 0]])
            b.append(prints[e + pairs[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        yield packed(pa.array(a.view(np.int64)), pa.array(b.view(np.int64)))
        if over.any():
            yield crowd(cells[:-2, edge[over]])

    def crowd(keys_of: np.ndarray):
        return packed(None, None, [pa.array(np.ascontiguousarray(x)) for x in keys_of])

    def packed(a, b, of=None):
        n = len(of[0]) if of else len(a)
        gap = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([gap if a is None else a, gap if b is None else b, *(of or [gap] * len(keys))], names=["a", "b", *keys])

    def run(batches):
        rest, skipped = np.zeros((len(keys) + 2, 0), np.int64), None
        for batch in batches:
            cells = np.stack([np.asarray(x) for x in batch.columns])
            if skipped is not None:
                cells = cells[:, (cells[:-2] != skipped[:, None]).any(axis=0)]
            cells = np.concatenate([rest, cells], axis=1)
            if not cells.shape[1]:
                continue
            last = (cells[:-2] == cells[:-2, -1:]).all(axis=0)
            whole = cells.shape[1] - int(last.sum())
            rest = cells[:, whole:]
            if whole:
                yield from links(cells[:, :whole])
            if bucket and rest.shape[1] > bucket:
                skipped, rest = rest[:-2, 0].copy(), rest[:, :0]
                yield crowd(skipped[:, None])
        if rest.shape[1]:
            yield from links(rest)

    schema = ", ".join(f"{c} long" for c in ("a", "b", *keys))
    return rows.select(*keys, "known", "print").repartition(*keys).sortWithinPartitions(*keys, "print").mapInArrow(run, schema)


def masked(rows: DataFrame, which: dict[int, int], index: str, key: str) -> DataFrame:
    """A row for each numbered mask: its number and the fingerprint's kept bits."""
    table = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(signed(m)).alias("m")) for t, m in which.items()])
    return rows.select("*", F.explode(table).alias("__of")).select(*rows.columns[:-2], F.col("__of.t").alias(index), F.col("print").bitwiseAND(F.col("__of.m")).alias(key), "known", "print")


def table_links(prints: DataFrame, which: dict[int, int], radius: int, bucket: int, reach: int) -> DataFrame:
    """Links by some of the tables, for rows (known, print)."""
    rows = masked(prints, which, "t", "key")
    found = settle(verified(rows, reach, bucket))
    links, crowded = found.filter("a is not null").select("a", "b"), found.filter("a is null").select("t", "key")
    if crowded.isEmpty():
        return links
    again = rows.join(crowded, ["t", "key"], "left_semi").select("t", "key", "known", "print")
    for v in [r[0] for r in crowded.select("t").distinct().collect()]:  # at most one for each table
        finer = masked(again.filter(F.col("t") == v), dict(enumerate(masks(radius, ~which[v] & (1 << 64) - 1))), "t2", "key2")
        links = links.unionByName(verified(finer, reach, None).select("a", "b"))
    return links


def near_links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET, reach: int | None = None) -> DataFrame:
    """Links between distinct fingerprints (column ``print``) that connect all pairs within the radius.
    With a ``reach`` over the radius, pairs up to it are linked as well where they meet in a table."""
    return table_links(prints.select(F.col("print").alias("known"), "print"), dict(enumerate(masks(radius))), radius, bucket, reach or radius)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, print, component_id): component_id is the smallest doc_id that links of at most
    ``radius`` differing bits reach, itself included."""
    own = settle(fingerprints(docs, id_col, text_col, shingle))
    nodes = own.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(nodes.select("print"), radius))
    placed = nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = placed.join(named, "root").select(F.col("print").alias("named"), "component_id")
    return own.join(names, F.col("print") == F.col("named")).select("doc_id", "print", "component_id")


def word_print(text: bytes | None) -> int:
    """A fingerprint of the different words, each with its length as weight: near copies differ in few
    bits of it, since the short and frequent words that all texts share weigh little."""
    from xxhash import xxh64_intdigest as xx

    words = sorted(set((text or b"").translate(LOWER_ASCII).split()))
    if not words:
        return 0
    hashes = np.array([xx(w, 42) for w in words], "<u8")
    weight = np.array([len(w) for w in words], np.float32)
    sums = weight @ np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return int(np.packbits(sums * 2 > weight.sum(), bitorder="little").view("<i8")[0])


def packed_shingles(own: DataFrame, shingle: int, parts: int) -> DataFrame:
    """(part, size, data): every text's different shingles with its node, in parts of the range of the
    hashes. A piece of data has the sorted hashes as differences, byte plane by byte plane, the places of
    their nodes in the list of nodes, and that list; so a shingle costs about half of a row of its own."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress

        def planes(x):
            return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()

        def flush(nodes, sets):
            values, owner = np.concatenate(sets), np.repeat(np.array(nodes, np.int64), [len(x) for x in sets])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            part = (values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
                who, place = np.unique(owner[a:b], return_inverse=True)
                gaps = np.diff(values[a:b], prepend=np.uint64(0))
                rows.append((int(part[a]), b - a, pack(planes(gaps) + planes(place.astype("<u4")) + who.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "size", "data"])

        nodes, sets, held = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.unique(np.array(shingle_hashes(text.as_py(), shingle), np.uint64))
                if len(hashes):
                    nodes.append(node)
                    sets.append(hashes)
                    held += len(hashes)
                if held >= PACKED:
                    yield from flush(nodes, sets)
                    nodes, sets, held = [], [], 0
        if held:
            yield from flush(nodes, sets)

    return own.select("node", "text").mapInArrow(run, "part int, size int, data binary")


def shared_shingles(packed: DataFrame) -> DataFrame:
    """(node, shingle, df) of the shingles that occur in more than one text; df is in how many."""

    def run(batches):
        import zstandard

        unpack, at, held = zstandard.ZstdDecompressor().decompress, None, []

        def close():
            values, nodes = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((nodes, values))
            values, nodes = values[order], nodes[order]
            new = np.r_[True, (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1])]  # copies of a text
            values, nodes = values[new], nodes[new]
            edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            size = np.diff(np.r_[edges, len(values)])
            df = np.repeat(size, size)
            some = df > 1
            columns = nodes[some], values[some].view(np.int64), df[some].astype(np.int64)
            for a in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in columns], names=["node", "shingle", "df"])

        for batch in batches:
            for part, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != at and held:
                    yield from close()
                    held = []
                at, raw = part, np.frombuffer(unpack(data.as_py()), np.uint8)
                gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
                place = np.ascontiguousarray(raw[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel()
                held.append((np.cumsum(gaps, dtype=np.uint64), raw[12 * n :].view("<i8")[place]))
        if held:
            yield from close()

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "node long, shingle long, df long")


def enough(pairs: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is enough: what two texts have in common is in the lists
    of shingles that more than one text has, and n counts all of a text's shingles."""
    side = lambda c: lists.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(common >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def shingle_lists(own: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, n, shingles) of the texts (node, text) that share shingles with others: the shared ones,
    rarest first, and the number of all. texts has (node, n)."""
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = shared_shingles(packed_shingles(own, shingle, max(1, -(-total // PART_SHINGLES))))
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("found"))
    return stored(lists.join(texts.select("node", "n"), "node").select("node", "n", F.col("found.shingle").alias("shingles")), "shingles")


def prefix_links(lists: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that, with the roots known already (node, root), join all texts of enough similarity:
    none is missed.

    By prefix filtering: in any common order of all shingles, two similar texts share one of the first
    n - ceil(similarity * n) + 1 shingles of each. The order is by the number of texts, rarest first, so
    shingles of a single text come first and are no candidates. While the texts that share a shingle and
    aren't joined yet would give over ``EASY`` pairs a row, they are compared in rounds: each with its
    neighbour, and with the text of another component that has the fewest shingles of its own, which in
    a group of near copies is closest to all others. Then all remaining pairs of shingles that still
    belong to several components are compared, so that a large group doesn't give all its pairs."""
    alone = F.col("n") - F.size("shingles")
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-6) + 1 - alone
    first = lists.filter(length > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("shingles", F.lit(1), length.cast("int"))).alias("pos", "shingle"))
    prefix = settle(first.select("shingle", "node", "n", "alone", (F.col("alone") + F.col("pos")).alias("place")))
    old = placed.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    def possible(x, y):
        """By the sizes, and by what can follow the first common shingle."""
        rest = F.least(x("n") - x("place"), y("n") - y("place"))
        return (x("root") != y("root")) & (rest >= F.lit(similarity / (1 + similarity)) * (x("n") + y("n")) - 1e-6)

    def several(roots):
        """The rows of the shingles whose texts are of several components, with their roots."""
        known = roots.select(F.col("node").alias("member"), "root")
        rows = settle(prefix.join(known, F.col("node") == F.col("member"), "left").select(*prefix.columns, F.coalesce("root", "node").alias("root")))
        mixed = settle(rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("texts")).filter("least <> most").select("shingle", "texts"))
        count, pairs = mixed.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum(F.col("texts") * (F.col("texts") - 1) / 2), F.lit(0))).first()
        return settle(rows.join(mixed.select("shingle"), "shingle")), pairs > EASY * count

    def compared(pairs, tried):
        """The new ones of some pairs, and the links among them."""
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = settle(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        return new, settle(enough(new, lists, similarity))

    def side(row):
        return lambda c: F.col(f"{row}.{c}")

    rows, crowded = several(placed)
    tried = links = None
    for _ in range(ROUNDS):
        if not crowded:
            break
        own_row, by = F.struct("alone", "node", "n", "place", "root"), Window.partitionBy("shingle")
        heads = rows.select("shingle", "root", own_row.alias("x"), F.min(own_row).over(by).alias("head"), F.lag(own_row).over(by.orderBy("node")).alias("before"))
        other = F.min(F.when(F.col("root") != F.col("head.root"), F.col("x"))).over(by)
        stars = heads.select("x", F.array("before", F.when(F.col("root") != F.col("head.root"), F.col("head")).otherwise(other)).alias("y")).select("x", F.explode("y").alias("y"))
        near = stars.filter("x.node <> y.node").filter(possible(side("x"), side("y"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        new, found = compared(near, tried)
        tried = new if tried is None else settle(tried.unionByName(new))
        if found.isEmpty():
            break
        links = found if links is None else settle(links.unionByName(found))
        rows, crowded = several(components(old.unionByName(links)))
    x, y = rows.alias("x"), rows.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & possible(side("x"), side("y"))
    _, found = compared(x.join(y.hint("merge"), meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), tried)
    return found if links is None else links.unionByName(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3, reach: int = 12, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, node, root): documents with one root are copies or are joined by links of texts whose
    word shingles have at least this Jaccard similarity; no such link is missed. Fingerprints of weighted
    words join most near copies first: those up to ``reach`` differing bits that meet in a covering table
    (all up to ``radius`` do) are linked by a spanning forest, and each of its links is verified on the
    texts' shingles. What they leave apart, prefix filtering finds, so the result doesn't rest on the
    tables. Work and shuffles are linear in the texts and the links; no group of candidates is compared
    all with all but where its texts share a rare shingle and aren't joined yet. node is a 64-bit digest
    of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches):
        for batch in batches:
            values = [word_print(x.as_py()) for x in batch.column(2)]
            sizes = [len(set(shingle_hashes(x.as_py(), shingle))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "node", "print", "n"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))
    marked = settle(own.mapInArrow(run, "doc_id long, node long, print long, n long"))
    texts = settle(marked.groupBy("node").agg(F.first("print").alias("print"), F.first("n").alias("n")))
    lists = shingle_lists(own, texts, shingle)
    nodes = settle(texts.groupBy("print").agg(F.min("node").alias("rep")))
    rep = lambda c: nodes.select(F.col("print").alias(f"print_{c}"), F.col("rep").alias(f"rep_{c}"))
    alike = texts.join(rep("a"), F.col("print") == F.col("print_a")).filter("node <> rep_a").select(F.col("node").alias("a"), F.col("rep_a").alias("b"))
    near = near_links(nodes.select("print"), radius, bucket, reach).distinct()
    near = near.join(rep("a"), F.col("a") == F.col("print_a")).join(rep("b"), F.col("b") == F.col("print_b")).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = settle(components(enough(settle(alike.unionByName(near)), lists, similarity)))
    stars = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = settle(texts.select("node").join(found.select(F.col("node").alias("member"), "root"), F.col("node") == F.col("member"), "left").select("node", F.coalesce("root", "node").alias("root")))
    joined = components(stars.unionByName(prefix_links(lists, known, similarity)))
    return marked.join(joined.select(F.col("node").alias("linked"), "root"), F.col("node") == F.col("linked"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, columns: tuple[str, ...] = DOC_COLUMNS, **how) -> DataFrame:
    """The documents without all but one of each near-duplicate class: the smallest doc_id stays, a null
    id only where there is no other; equal rows count as copies."""
    found = settle(near_duplicates(docs, **how))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    best = found.groupBy("root").agg(F.min(place).alias("best")).select(F.col("best.doc_id").alias("kept_id"), F.col("best.node").alias("kept_node"))
    node = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    match = docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")) & (node == F.col("kept_node"))
    kept = docs.join(best, match, "left_semi").select(*columns)
    twins = settle(found.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")))
    if twins.isEmpty():
        return kept
    twin = kept["doc_id"].cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.coalesce(kept["text"].cast("string"), F.lit(""))) == F.col("kept_node"))
    return kept.join(twins, twin, "left_anti").unionByName(kept.join(twins, twin, "left_semi").dropDuplicates(["doc_id", "text"]))


def hex_print(column: str = "print"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint (3-word shingles) and component (3 or fewer differing bits)."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", hex_print().alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
QUERIES = {"op10_simhash": op10_simhash}
