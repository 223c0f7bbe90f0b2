"""Words of a text as Spark columns, with no Python: shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewing.llm.common import lowered

#: So many rows (some 32 bytes each) may be broadcast to find their texts; beyond, the texts are shuffled.
FEW_KEYS = 200_000
#: ASCII letters and digits and everything beyond ASCII are of words; all else parts them.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(column: str = "text") -> Column:
    """The lower-cased words in order; an empty array for a null or empty text."""
    return F.array_remove(F.split(lowered(column), PARTING), "")


def text_keys(column: str = "text") -> list[Column]:
    """Two 64-bit digests that stand for a text in a join (null and empty differ)."""
    return [F.xxhash64(F.col(column)).alias("k1"), F.xxhash64(F.lit(1), F.col(column)).alias("k2")]


def shifted(words: str, offsets: list[int]) -> Column:
    """For each position an element with the word at each offset from it (null beyond the end)."""
    return F.arrays_zip(*[F.col(words) if k == 0 else F.slice(F.col(words), k + 1, F.greatest(F.size(words), F.lit(1))).alias(f"s{k}") for k in offsets])


def same_row(left, right) -> Column:
    """Null-safe equality of (doc_id, k1, k2)."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.k1 == right.k1) & (left.k2 == right.k2)


def with_words(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of found (doc_id, k1, k2 and more; settled, as it is read twice) with the words w of their
    texts. The keys are counted: few of them are broadcast, so that no other text is shuffled."""
    keys = found.select("doc_id", "k1", "k2").distinct()
    keys = F.broadcast(keys) if keys.count() <= FEW_KEYS else keys
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), *[k.alias(f"own_{i}") for i, k in enumerate(text_keys(text_col))], F.col(text_col).alias("own_text"))
    named = texts.join(keys, texts.own_id.eqNullSafe(keys.doc_id) & (texts.own_0 == keys.k1) & (texts.own_1 == keys.k2)).select("own_id", "own_0", "own_1", "own_text")
    once = named.dropDuplicates(["own_id", "own_0", "own_1"]).select("own_id", "own_0", "own_1", word_array("own_text").alias("w"))
    return found.join(once, found.doc_id.eqNullSafe(once.own_id) & (found.k1 == once.own_0) & (found.k2 == once.own_1)).select(*found.columns, "w")
