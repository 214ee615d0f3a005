"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined in Spark to the places of the same hashes in license templates; hits
are counted by diagonal (word place minus template place), neighbouring diagonals are merged, so that a template with a few
inserted or missing words still votes together, and the spans are verified by the words themselves: what counts is the greatest number of
the template's words that stand in the span in the template's order, within hits. Of spans that overlap the one that fits best stays.

k is K, or the number of words of a shorter template. The template table is a fixed parameter of this module's size: its hashes, as a set,
sort out the places that hit nothing before they become rows, and the join with its places is a broadcast. What is shuffled afterwards is
one header row a document and the hits, first put together by diagonal on the map side.

Defined results: a null text is an empty one (0 words, no labels, score 0). Each row of the input is judged for itself, repeated
rows included. A long text is scanned whole; a document with very many hits only costs more rows of the shuffle. Other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let

#: A-Z are lower-cased afterwards, word by word; the words are the same.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 4

#: Base phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The method's own templates: label and the words of a public notice (fixed values).
NOTICES = (
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
#: Share of a template's words that a span must hold in order; diagonals this near, and spans this near, are merged.
COVERAGE, DRIFT = 0.8, 3


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, base, size, k, grams, at, words, gram): one row for each k-gram of each template of ``size`` words."""
    rows = []
    for t, (label, text, base) in enumerate([(b, a, True) for a, b in phrases] + [(a, b, False) for a, b in notices]):
        words = text.split()
        k = min(K, len(words))
        rows += [(t, label, base, len(words), k, len(words) - k + 1, i, words[i : i + k]) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, k int, grams int, at int, words array<string>").withColumn("gram", F.xxhash64("words"))


def lowered(word: Column) -> Column:
    """A-Z in lower case; a word with a letter outside ASCII that lower-cases to an ASCII one, which is shorter in UTF-8, stays as it is."""
    return let(F.lower(word), lambda low: F.when(F.octet_length(low) == F.octet_length(word), low).otherwise(word))


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Hits by (row, template, diagonal); the header rows, with the number n of words, have no template."""
    table = templates(docs.sparkSession, phrases, notices)
    listed: dict[int, list[int]] = {}
    for r in table.select("k", "gram").distinct().collect():
        listed.setdefault(r["k"], []).append(r["gram"])
    words = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS), lambda w: w != ""), lowered)
    hit = "struct<place:int,words:array<string>,n:bigint>"

    def found(w: Column) -> Column:
        head = F.array(F.struct(F.lit(None).cast("int").alias("place"), F.array().cast("array<string>").alias("words"), F.size(w).cast("long").alias("n")).cast(hit))
        parts = [head]
        for k, grams in sorted(listed.items()):
            places = F.when(F.size(w) < k, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - k))
            # the hash of an array of words is that of the words one after another
            some = F.filter(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).isin(grams))
            parts.append(F.transform(some, lambda i: F.struct(i.alias("place"), F.slice(w, i + 1, k).alias("words"), F.lit(None).cast("long").alias("n")).cast(hit)))
        return F.concat(*parts)

    row = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), let(words, found).alias("g"))
    rows = row.select("doc_id", "row", F.explode("g").alias("g")).select("doc_id", "row", "g.place", "g.n", F.col("g.words").alias("found")).withColumn("gram", F.xxhash64("found"))
    hits = rows.join(F.broadcast(table), "gram", "left").where(F.col("n").isNotNull() | (F.col("found") == F.col("words")))
    by = ["row", "doc_id", "template", "label", "base", "size", "k", "grams"]
    return (
        hits.withColumn("diagonal", F.col("place") - F.col("at"))
        .groupBy(*by, "diagonal")
        .agg(F.max("n").alias("n"), F.count("at").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_list(F.when(~F.col("base"), F.struct("place", "at"))).alias("hits"))
    )


def in_order(hits: Column, k: Column, size: Column) -> Column:
    """The greatest number of a template's words that ``hits`` (place, at of k-grams) show in the order of the template.

    ``most`` holds for each number of the template's first words how many of them were met in order so far.
    """
    cells = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((h["place"] + i).alias("place"), (-h["at"] - i).alias("before")))))))
    zero = F.transform(F.sequence(F.lit(0), size), lambda i: F.lit(0))

    def step(most, cell):
        at = -cell["before"]  # greater places of the template come first at one place of the text, so that only one of them counts
        return let(F.get(most, at) + 1, lambda n: F.transform(most, lambda x, b: F.when(b > at, F.greatest(x, n)).otherwise(x)))

    return F.element_at(F.aggregate(cells, zero, step), -1)


def merged(diagonals: DataFrame) -> DataFrame:
    """Spans: neighbouring diagonals of a document and template (at most DRIFT apart, their places too) are one. A base phrase must stand
    word for word on one diagonal; of the others, the span's words are verified against the template."""
    w = W.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT) | (F.col("first") - F.lag("last").over(w) > F.col("k") + DRIFT) | F.lag("diagonal").over(w).isNull()
    spans = diagonals.withColumn("new", F.when(F.col("base"), F.lit(1)).otherwise(apart.cast("int"))).withColumn("span", F.sum("new").over(w))
    spans = spans.groupBy("row", "doc_id", "template", "label", "base", "size", "k", "grams", "span").agg(
        F.max("n").alias("n"), F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + F.col("k")).alias("stop"), F.flatten(F.collect_list("hits")).alias("hits")
    )
    # words that hits can show at all, before their order is looked at
    shown = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + F.col("k") - 1)))))
    coverage = F.when(F.col("base"), F.col("votes") / F.col("grams")).when(shown >= COVERAGE * F.col("size"), in_order(F.col("hits"), F.col("k"), F.col("size")) / F.col("size"))
    fits = F.when(F.col("base"), F.col("coverage") == 1).otherwise(F.col("coverage") >= COVERAGE)
    return spans.withColumn("coverage", coverage).drop("hits").where(F.col("n").isNotNull() | fits)


def license_scan(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count where all their words stand (a full diagonal); the other templates from ``COVERAGE`` of their words, unless a span
    that overlaps holds a greater share of another, or as great a share of a longer one.
    """
    spans = merged(scan(docs, text, phrases, notices))
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    notice = F.struct("coverage", "size", "template", "label", "first", "stop")
    by_row = spans.groupBy("row", "doc_id").agg(
        F.max("n").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_list(F.when(~base, notice)).alias("spans"),
    )
    better = lambda s, t: (s["first"] < t["stop"]) & (t["first"] < s["stop"]) & (F.struct(t["coverage"], t["size"], t["template"]) > F.struct(s["coverage"], s["size"], s["template"]))
    best = F.filter("spans", lambda s: ~F.exists("spans", lambda t: better(s, t)))
    by_row = by_row.withColumn("spans", F.when(F.size("spans") > 1, best).otherwise(F.col("spans")))
    labels = F.array_union("base_labels", F.transform("spans", lambda s: s["label"]))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))
    return by_row.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))


def op3(docs: DataFrame) -> DataFrame:
    return license_scan(docs.select("doc_id", "text"))
