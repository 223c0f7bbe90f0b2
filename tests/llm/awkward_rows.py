"""Tables with nulls, ties, repeated rows, empty and very long texts."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
TABLES = {
    "documents": DOCS,
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def prose(seed: int, n: int, letters: str = "aeinorstlu") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))


ITEM = prose(900, 30)
LONG = prose(901, 20_000)
PASSAGE = prose(902, 120)


def awkward_documents() -> list[tuple]:
    base = prose(1, 150)
    words = base.split()
    near = " ".join([*words[:70], "changed", *words[71:]])
    texts = [
        None, "", "   \n\t ", "word", "Word", "two words", base, base, near, base.upper(), LONG, LONG[5:], prose(2, 90) + " " + PASSAGE + " " + prose(3, 60), prose(4, 77) + " " + PASSAGE + " " + prose(5, 33),
        "x " * 3000, "éü中" * 400, "éü中" * 399 + "!", prose(6, 40) + " " + ITEM + " " + prose(7, 40), "licensed under the MIT License. GNU general public license", "a\x00b\x0bc", "\U0001f600 " * 50,
    ]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None), (None, None, None, None, None), (8, prose(8, 50), "en", "src0", 1)]
    return rows + [(100 + i, prose(50 + i, 60), "en", "src0", 1) for i in range(30)]


ROWS = {
    "documents": awkward_documents(),
    "labels": [(6, 1, 0), (6, 1, 0), (14, 0, 0), (15, None, 0), (None, 1, 0), (999, 1, 0), (10, 7, 0), *[(100 + i, 1, 0) for i in range(30)], (3, 0, 0), (3, 1, 0)],
    "benchmark": [(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, prose(903, 20)), (4, "too short")],
    "pages": [(1, "http://a", "<p>" + "z" * 1200), (2, None, "<p>" + "z" * 1200), (3, "http://b\nx", None), (4, "http://c", ""), (4, "http://c", ""), (None, "http://n", "<p>" + "z" * 1200), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 499), (8, "u", "é" * 499), (9, "u", "é" * 500), (10, "u", "é" * 500), (11, "u", "y" * 300_000)],
    "embeddings": [(0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [0.0, 1.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [float("nan"), 0.0, 1.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (50, [1.0, 1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [-1.0, 0.0, 0.0], 1), (100, [1.0, 0.0], 1)],
}


