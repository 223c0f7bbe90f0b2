"""License scan by diagonal voting.

All rolling word k-gram hashes of the texts (2 words, or 4 for templates of 8 words or more) are joined
to their places in the templates (a fixed list, broadcast). A hit votes for its diagonal, the offset of
the text against the template. Votes are counted by document, template and diagonal. Neighbouring
diagonals (words put in or left out) merge to one span: from each voted diagonal on, those at most
``slack`` of the template's words further. A span whose votes cover ``votes`` of the template's k-grams
is verified: its words are cut out of the text and aligned with the template in order, word by word.
Its share is the number of equal words over the template's words and the foreign words between them, and
it stands from ``cover`` on. So every word that is missing, changed or put in lowers the share, and only
a verbatim copy scores 1.

The base phrases are templates that must stand whole: all their 2-word hashes on one diagonal.

Only DataFrame functions are used; texts are read again only where a span is to be verified. A row is
known by its id and two digests of its text, so nulls and repeated rows are safe: equal rows get equal
results. Null and empty texts have no words and no labels, and score 0. Only the named columns of the
input are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.llm.common import settle, table
from slatewing.llm.words import same_row, shifted, text_keys, with_words, word_array

# The phrases whose places count, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wordings of well-known notices, and the labels that the method adds.
TEMPLATES = (
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
# Bodies of well-known licenses (lower case, without marks), and the labels for them.
BODIES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
        "mit-text",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
        "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
        "other tortious action arising out of or in connection with the use or performance of this software",
        "isc-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd-text",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0-text",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details",
        "gpl-3.0-text",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted "
        "to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib-text",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
        "compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense-text",
    ),
)
COVER, VOTES = 0.75, 0.5
SLACK = 0.25
GRAMS, LONG = (2, 4), 8


def template_list(phrases, templates) -> list[tuple]:
    """(number, words, label, base, k, slack in words) of every template."""
    out = []
    for t, (text, label) in enumerate((*phrases, *templates)):
        words, base = text.split(), t < len(phrases)
        out.append((t, words, label, base, GRAMS[not base and len(words) >= LONG], max(1, int(SLACK * len(words)))))
    return out


def template_rows(spark: SparkSession, known: list[tuple]) -> DataFrame:
    """One row for every k-gram of a template: its hash, template number, place, number of k-grams."""
    rows = [(k, words[i : i + k], t, i, len(words) - k + 1) for t, words, _, _, k, _ in known for i in range(len(words) - k + 1)]
    made = spark.createDataFrame(rows, "k int, words array<string>, template int, place int, size int")
    gram = F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(F.lit(k), *[F.col("words")[i] for i in range(k)])) for k in GRAMS])
    return made.select(gram.alias("gram"), "template", "place", "size")


def aligned(first, slack):
    """(equal, begin, end) of the template ``t`` in the words ``w``, on the diagonals from ``first`` to
    ``first + slack``: each template word in turn is looked for behind the last one found."""

    def step(s, x):
        low = F.greatest(first + x["i"], s["end"], F.lit(0))
        width = F.least(first + x["i"] + slack, F.size("w") - 1) - low + 1
        at = F.when(width > 0, F.array_position(F.slice("w", low + 1, F.greatest(width, F.lit(0))), x["t"])).otherwise(F.lit(0)).cast("int")
        there = F.struct((s["equal"] + 1).alias("equal"), F.coalesce(s["begin"], low + at - 1).alias("begin"), (low + at).alias("end"))
        return F.when(at > 0, there).otherwise(s)

    words = F.transform("t", lambda x, i: F.struct(x.alias("t"), i.alias("i")))
    return F.aggregate(words, F.struct(F.lit(0).alias("equal"), F.lit(None).cast("int").alias("begin"), F.lit(0).alias("end")), step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=(*TEMPLATES, *BODIES), cover: float = COVER, votes: float = VOTES) -> DataFrame:
    """Spans: doc_id, k1, k2, template, label, base, first_word, n_words, share (of the template), stands."""
    spark, known = docs.sparkSession, template_list(phrases, templates)
    about = spark.createDataFrame([(t, words, label, base, slack) for t, words, label, base, _, slack in known], "template int, t array<string>, label string, base boolean, slack int")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col), word_array(text_col).alias("w"))
    picked = ["w", *[f"s{i}" for i in range(1, max(GRAMS))]]
    gram = [F.when(F.col(f"x.{picked[k - 1]}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"x.{c}") for c in picked[:k]])) for k in GRAMS]
    grams = texts.select("doc_id", "k1", "k2", F.posexplode(shifted("w", list(range(max(GRAMS))))).alias("pos", "x")).select("doc_id", "k1", "k2", "pos", F.explode(F.array(*gram)).alias("gram"))
    hits = grams.join(F.broadcast(template_rows(spark, known)), "gram")
    key = ["doc_id", "k1", "k2", "template"]
    voted = hits.groupBy(*key, "size", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    voted = voted.join(F.broadcast(about.select("template", "base", "slack")), "template")
    # Spans from each voted diagonal on; the largest slack bounds the window, the template's own the span.
    ahead = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, max(x[5] for x in known))
    spans = voted.withColumn("near", F.when(~F.col("base"), F.collect_list(F.struct("diagonal", "places")).over(ahead)))
    seen = F.size(F.array_distinct(F.flatten(F.transform(F.filter("near", lambda x: x["diagonal"] <= F.col("diagonal") + F.col("slack")), lambda x: x["places"]))))
    enough = F.when(F.col("base"), F.size("places") == F.col("size")).otherwise(seen >= F.lit(votes) * F.col("size"))
    standing = settle(spans.filter(enough).select(*key, "base", "slack", F.col("diagonal").cast("int").alias("diagonal")))
    names = F.broadcast(about.select("template", "t", "label"))
    whole = standing.filter("base").join(names, "template").select("doc_id", "k1", "k2", "template", "label", "base", F.col("diagonal").alias("first_word"), F.size("t").alias("n_words"), F.lit(1.0).alias("share"))
    wide = with_words(docs, standing.filter("not base"), id_col, text_col).join(names, "template").withColumn("m", aligned(F.col("diagonal"), F.col("slack"))).filter("m.equal > 0")
    length = F.col("m.end") - F.col("m.begin")
    share = F.col("m.equal") / (F.size("t") + length - F.col("m.equal"))
    checked = wide.select("doc_id", "k1", "k2", "template", "label", "base", F.col("m.begin").alias("first_word"), length.alias("n_words"), share.alias("share"))
    return whole.unionByName(checked).distinct().withColumn("stands", F.col("share") >= cover)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document: counts, places and labels of the base phrases and of the method."""
    base, stands = F.col("base"), F.col("stands")
    found = scan(docs, id_col, text_col, **how).groupBy("doc_id", "k1", "k2").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("own"), F.array_sort(F.collect_set(F.when(stands, F.col("label")))).alias("all"), F.max("share").alias("score"),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col), F.size(word_array(text_col)).cast("long").alias("n_words"))
    joined = rows.join(found, same_row(rows, found), "left")
    joined_text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return joined.select(
        rows.doc_id, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined_text("own").alias("base_labels"), joined_text("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op8_license": op8_license}
