"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of the words in a window and ignore the others; equal chosen words give equal
hashes even if ignored words were substituted. The documents' positions whose seeds the benchmark has
are joined to the items' places, each hit giving a diagonal (the item's start in the document). On every
diagonal the document's words are compared with the whole item: matches count 1 and mismatches -1, and
the best stretch must reach ``least``. A passage of ``least + 2 s`` words with s substitutions reaches it.

Repetitive texts: a hit whose seed stood as far back in the document as in the item is left out, as the
hit there is on the same diagonal. So a word that is repeated n times in a document and m times in an
item gives about n + m diagonals instead of n times m hits; a pair's diagonals are one list, at most as
long as document and item together, beside one copy of their words.

Only DataFrame functions are used; words leave a task only where a seed has hit. The benchmark is
broadcast in parts of about ``PART`` seeds (their sizes are counted first; a part that is over twice as
large, such as one huge item, is joined by shuffling), one pass over the documents for each part.

Defined results: null and empty texts and items have no seeds and no overlap; items shorter than
``least`` words can't be found; equal rows give equal results; a null item_id is kept. Only the named
columns of the inputs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.llm.common import settle, table
from slatewing.llm.words import shifted, text_keys, with_words, word_array

MASKS = ("111111", "1110111", "11001111", "101101011")
LEAST = 9
PART = 1 << 19


def seeds(row: str, masks) -> list:
    """A hash for each mask, null where the window passes the end."""
    out = []
    for k, mask in enumerate(masks):
        picked = [F.col(f"{row}.{'w' if i == 0 else f's{i}'}") for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(F.col(f"{row}.s{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(k), *picked)))
    return out


def seeded(texts: DataFrame, masks) -> DataFrame:
    """Texts with an array column w: a row (pos, seed) for each position and mask."""
    span = range(max(map(len, masks)))
    return texts.select("*", F.posexplode(shifted("w", list(span))).alias("pos", "x")).select(*texts.columns, "pos", F.explode(F.array(*seeds("x", masks))).alias("seed")).filter("seed is not null")


def stretch(words, item):
    """(best, end): the best sum of +1 for equal and -1 for unequal words along the item."""
    at = F.zip_with(words, item, lambda a, b: F.when(a == b, 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))
    step = lambda s, x: F.struct(F.greatest(s["best"], s["now"] + x).alias("best"), F.greatest(F.lit(0), s["now"] + x).alias("now"))
    return F.aggregate(at, start, step, lambda s: s["best"])


def back(rows: DataFrame, *key: str) -> DataFrame:
    """With the distance to the seed's last place before this one (null: none)."""
    return rows.withColumn("back", F.col("pos") - F.lag("pos").over(Window.partitionBy(*key, "seed").orderBy("pos")))


def diagonals(places: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, item_key, lines): the distinct diagonals of each pair. places has (doc_id, k1,
    k2, pos, seed, back), known (item_key, place, item_seed, item_back)."""
    hit = (F.col("seed") == F.col("item_seed")) & (F.col("back").isNull() | F.col("item_back").isNull() | (F.col("back") != F.col("item_back")))
    lines = places.join(known, hit).select("doc_id", "k1", "k2", "item_key", (F.col("pos") - F.col("place")).alias("first_word")).distinct()
    return lines.groupBy("doc_id", "k1", "k2", "item_key").agg(F.collect_list("first_word").alias("lines"))


def best_line():
    """(score, early) of a pair's best diagonal, ``early`` being minus its first word. The diagonals come
    by the number of words that they share with the item, and one that could not win is not compared."""
    begin = lambda d: F.greatest(d, F.lit(0))
    length = lambda d: F.greatest(F.least(F.size("item") - begin(d) + d, F.size("w") - begin(d)), F.lit(0))
    ordered = F.array_sort(F.transform("lines", lambda d: F.struct((-length(d)).alias("less"), d.alias("d"))))

    def step(best, x):
        d, n = x["d"], -x["less"]
        score = stretch(F.slice("w", begin(d) + 1, n), F.slice("item", begin(d) - d + 1, n))
        return F.when(n < best["score"], best).otherwise(F.greatest(best, F.struct(score.alias("score"), (-d).alias("early"))))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("score"), F.lit(-(1 << 31)).cast("int").alias("early")), step)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks=MASKS, least: int = LEAST) -> DataFrame:
    """(doc_id, k1, k2, item_id, first_word, score, n_item_words): the best overlap of each document
    with each item that it overlaps (ties: the first); first_word may be negative where the item's start
    is cut off."""
    items = settle(benchmark.select(F.col(item_col).cast("long").alias("item_id"), word_array(item_text).alias("item")).distinct().withColumn("item_key", F.xxhash64("item_id", "item")))
    size = items.select(F.sum(F.size("item"))).first()[0] or 0
    parts = -(-size * len(masks) // PART) or 1
    part_of = F.pmod("item_key", F.lit(parts))
    sizes = dict(items.groupBy(part_of).agg(F.sum(F.size("item")) * len(masks)).collect())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col), word_array(text_col).alias("w"))
    grown, found = seeded(texts, masks).select("doc_id", "k1", "k2", "pos", "seed"), None
    for part in range(parts):
        light = F.broadcast if sizes.get(part, 0) <= 2 * PART else lambda df: df
        own = items.filter(part_of == part)
        known = back(seeded(own.select("item_key", F.col("item").alias("w")), masks).select("item_key", "pos", "seed"), "item_key")
        known = settle(known.select("item_key", F.col("pos").alias("place"), F.col("seed").alias("item_seed"), F.col("back").alias("item_back")))
        asked = light(known.select("item_seed").distinct())
        places = back(grown.join(asked, F.col("seed") == F.col("item_seed"), "left_semi").distinct(), "doc_id", "k1", "k2")
        pairs = settle(diagonals(places, light(known)))
        wide = with_words(docs, pairs, id_col, text_col).join(light(own), "item_key")
        scored = wide.select("doc_id", "k1", "k2", "item_id", F.size("item").alias("n_item_words"), best_line().alias("m")).filter(F.col("m.score") >= least)
        one = scored.select("doc_id", "k1", "k2", "item_id", (-F.col("m.early")).alias("first_word"), "m.score", "n_item_words")
        found = one if found is None else found.unionByName(one)
    # Items with one id count as one.
    most = F.max(F.struct("score", (-F.col("first_word")).alias("early"), "n_item_words"))
    return found.groupBy("doc_id", "k1", "k2", "item_id").agg(most.alias("m")).select("doc_id", "k1", "k2", "item_id", (-F.col("m.early")).alias("first_word"), "m.score", "m.n_item_words")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, all columns, without those that overlap an item."""
    found = overlaps(docs, benchmark, id_col, text_col, **how).select("doc_id", "k1", "k2").distinct()
    names = found.toDF("found_id", "found_1", "found_2")
    one, two = text_keys(text_col)
    return docs.join(names, docs[id_col].cast("long").eqNullSafe(F.col("found_id")) & (one == F.col("found_1")) & (two == F.col("found_2")), "left_anti")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that overlap."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("first_word").cast("long").alias("first_word"), F.col("score").cast("int").alias("score"), "n_item_words")


SQL: dict[str, str] = {}
QUERIES = {"op7_spaced_seeds": op7_spaced_seeds}
