"""Licence scan: normalised text against licence templates, by the Dice coefficient of word bigrams.

Units are the lines of a text, and the whole text where it has more than one line. A unit is
lower-cased and cut into runs of letters and digits. Dice over bags of bigrams, ``2 * common / (a + b)``,
can reach the threshold only if the unit's size lies within bounds of a template's, which prunes
units by their number of words alone. The bigrams of the others meet those of the templates in
a broadcast join (templates are limited to ``MOST_TEMPLATE_WORDS`` words), so only shared bigrams are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MOST_TEMPLATE_WORDS = 1_000_000

# Notices by which texts state their licence, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except"
        " in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
        " fee is hereby granted, provided that the above copyright notice and this permission notice appear"
        " in all copies.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met:",
    ),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the"
        " License, or (at your option) any later version.",
    ),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of"
        " the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    """The built-in templates: template (number), licence, text."""
    rows = [(i, licence, text) for i, (licence, text) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "template int, licence string, text string")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _bigrams(words: Column) -> Column:
    """Hashes of neighbouring words, in order; needs two words."""
    pairs = F.arrays_zip(
        F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words) - 1).alias("b")
    )
    return F.transform(pairs, lambda p: F.xxhash64(p["a"], p["b"]))


def scan(docs: DataFrame, notices: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit that states a licence: doc_id, line, licence, template, dice.

    ``docs`` has doc_id and text; other columns are not read. ``line`` counts from 1; 0 is the whole text.
    ``notices`` (template, licence, text) are the templates, the built-in ones by default; their words are
    counted and an error is raised beyond ``MOST_TEMPLATE_WORDS``. Of several templates that reach the
    threshold the most similar is given, of equal ones that with the smaller number. Texts, lines
    and templates of fewer than two words, null and empty ones have no bigrams and match nothing. Rows alike in id
    and text count once; rows without an id are kept apart from others by their text only. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    notices = templates(spark) if notices is None else notices
    cut = notices.select("template", "licence", _words(F.col("text")).alias("words"))
    cut = cut.filter(F.size("words") >= 2)
    sizes = cut.select("template", "licence", (F.size("words") - 1).alias("size"))
    known = {r["template"]: r["size"] for r in sizes.select("template", "size").limit(MOST_TEMPLATE_WORDS).collect()}
    if sum(known.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MOST_TEMPLATE_WORDS} words")
    if not known:
        return spark.createDataFrame(
            [], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line int, licence string, template int, dice double"
        )
    bag = cut.select("template", (F.size("words") - 1).alias("whole"), F.explode(_bigrams(F.col("words"))).alias("bigram"))
    bag = bag.groupBy("template", "whole", "bigram").agg(F.count("*").alias("there"))

    # 2 * min(a, b) / (a + b) >= t  <=>  b * t / (2 - t) <= a <= b * (2 - t) / t
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    size = F.size("words") - 1
    spans: list[list[float]] = []
    for number in sorted(known.values()):
        if spans and number * low <= spans[-1][1] + 1:
            spans[-1][1] = number * high + 1e-9
        else:
            spans.append([number * low - 1e-9, number * high + 1e-9])
    fits = F.lit(False)
    for first, last in spans:
        fits = fits | size.between(first, last)
    lines = F.split("text", "\n")
    units = docs.select("doc_id", F.xxhash64("text").alias("of"), "text", lines.alias("lines")).select(
        "doc_id", "of", F.explode(
            F.transform(
                F.when(F.size("lines") > 1, F.concat(F.array("text"), F.col("lines"))).otherwise(
                    F.concat(F.array(F.lit("")), F.col("lines"))
                ),
                lambda part, i: F.struct(i.cast("int").alias("line"), _words(part).alias("words")),
            )
        ).alias("unit"),
    )
    sized = units.select("doc_id", "of", "unit.line", "unit.words").filter(fits)
    grams = sized.select(
        "doc_id", "of", "line", size.alias("size"), F.posexplode(_bigrams(F.col("words"))).alias("at", "bigram")
    )
    vocabulary = F.broadcast(bag.select("bigram").distinct())
    shared = grams.join(vocabulary, "bigram", "left_semi").distinct()
    counts = shared.groupBy("doc_id", "of", "line", "size", "bigram").agg(F.count("*").alias("here"))
    common = (
        counts.join(F.broadcast(bag), "bigram")
        .filter(F.col("size").between(F.col("whole") * low - 1e-9, F.col("whole") * high + 1e-9))
        .groupBy("doc_id", "of", "line", "size", "template")
        .agg(F.sum(F.least("here", "there")).alias("common"))
    )
    dice = F.col("common") * 2.0 / (F.col("c.size") + F.col("t.size"))
    scored = (
        common.alias("c")
        .join(F.broadcast(sizes.alias("t")), "template")
        .select("doc_id", "of", "line", "licence", "template", dice.alias("dice"))
        .filter(F.col("dice") >= threshold)
    )
    best = F.min(F.struct((-F.col("dice")).alias("order"), "template", "licence", "dice")).alias("best")
    return (
        scored.groupBy("doc_id", "of", "line")
        .agg(best)
        .select("doc_id", "line", "best.licence", "best.template", "best.dice")
    )


def windows(docs: DataFrame, notices: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text and licence stated anywhere in it: doc_id, licence, template, first_word, dice.

    Texts are read across line breaks, so wrapped notices and those inside longer paragraphs are found. Each
    template is compared with every stretch of as many word pairs as it has itself, which is where its size
    bounds lead; pairs that a shorter text lacks count as not shared. Of a licence's stretches the most similar
    is given, of equal ones that of the smaller template, then the earliest; ``first_word`` counts from 0.
    ``docs``, ``notices`` and awkward rows are as for ``scan``.

    Shared pairs are gathered by text, template and cell of the template's size: what begins in a cell
    ends in the next one, so a group has at most twice the template's size, whatever the text's length. Groups
    with too few shared pairs for the threshold are left before anything is compared.
    """
    spark = docs.sparkSession
    notices = templates(spark) if notices is None else notices
    cut = notices.select("template", "licence", _words(F.col("text")).alias("words")).filter(F.size("words") >= 2)
    cut = cut.withColumn("size", F.size("words") - 1)
    total = cut.agg(F.sum("size")).first()[0] or 0
    if total > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MOST_TEMPLATE_WORDS} words")
    bag = cut.select("template", "licence", "size", F.explode(_bigrams(F.col("words"))).alias("bigram"))
    bag = bag.groupBy("template", "licence", "size", "bigram").agg(F.count("*").cast("int").alias("there"))

    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("of"), _words(F.col("text")).alias("words"))
    pairs = texts.filter(F.size("words") >= 2).select("doc_id", "of", F.posexplode(_bigrams(F.col("words"))).alias("at", "bigram"))
    cell = F.floor(F.col("at") / F.col("size"))
    hits = pairs.join(F.broadcast(bag), "bigram").select(
        "doc_id", "of", "template", "licence", "size", F.struct("at", "bigram", "there").alias("hit"),
        F.explode(F.array(cell, cell - 1)).alias("cell"),
    )
    groups = hits.groupBy("doc_id", "of", "template", "licence", "size", "cell").agg(F.collect_set("hit").alias("hits"))
    enough = threshold * F.col("size") - 1e-9
    groups = groups.filter(F.size("hits") >= enough).withColumn("hits", F.array_sort("hits"))

    def place(h: Column) -> Column:
        # A pair counts in the stretches that begin behind its ``there``-th earlier occurrence, if it has one.
        same = F.filter("hits", lambda x: (x["bigram"] == h["bigram"]) & (x["at"] < h["at"]))
        behind = F.when(F.size(same) >= h["there"], F.get(same, F.size(same) - h["there"])["at"]).otherwise(-1)
        return F.struct(h["at"].alias("at"), behind.alias("behind"))

    def common(p: Column) -> Column:
        inside = F.filter("places", lambda x: (x["at"] >= p) & (x["at"] < p + F.col("size")) & (x["behind"] < p))
        return F.struct(F.size(inside).alias("common"), (-p).alias("before"))

    begins = F.filter("places", lambda x: F.floor(x["at"] / F.col("size")) == F.col("cell"))
    placed = groups.withColumn("places", F.transform("hits", place)).drop("hits")
    best = placed.withColumn("best", F.array_max(F.transform(begins, lambda x: common(x["at"]))))
    dice = F.col("best.common") / F.col("size")
    found = best.select(
        "doc_id", "of", "licence", "template", (-F.col("best.before")).alias("first_word"), dice.alias("dice")
    ).filter(F.col("dice") >= threshold)
    first = F.min(F.struct((-F.col("dice")).alias("order"), "template", "first_word", "dice")).alias("first")
    return (
        found.groupBy("doc_id", "of", "licence")
        .agg(first)
        .select("doc_id", "licence", "first.template", "first.first_word", "first.dice")
    )


def _sql_templates() -> str:
    rows = ",\n    ".join(
        f"({i}, '{licence}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (licence, text) in enumerate(NOTICES)
    )
    return f"(VALUES {rows}) n(template, licence, text)"


ORACLE = f"""
WITH t AS (
  SELECT template, licence, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM {_sql_templates()}),
u AS (
  SELECT doc_id, i AS line, regexp_extract_all(lower(part), '[\\p{{L}}\\p{{N}}]+') AS w FROM (
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS part
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
    UNION ALL
    SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10)))),
tb AS (
  SELECT template, licence, b, len(w) - 1 AS size, count(*) AS n FROM (
    SELECT template, licence, w, unnest(list_zip(w[:-2], w[2:])) AS b FROM t)
  GROUP BY ALL),
ub AS (
  SELECT doc_id, line, b, size, count(*) AS n FROM (
    SELECT doc_id, line, len(w) - 1 AS size, unnest(list_zip(w[:-2], w[2:])) AS b FROM u WHERE len(w) > 1)
  GROUP BY ALL),
s AS (
  SELECT doc_id, line, licence, template, 2.0 * sum(least(ub.n, tb.n)) / (ub.size + tb.size) AS dice
  FROM ub JOIN tb USING (b) GROUP BY doc_id, line, licence, template, ub.size, tb.size)
SELECT doc_id, CAST(line AS INTEGER) AS line, licence, CAST(template AS INTEGER) AS template,
       CAST(dice AS DOUBLE) AS dice
FROM s WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) = 1
"""

ORACLE_WINDOWS = f"""
WITH t AS (
  SELECT template, licence, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM {_sql_templates()}),
tb AS (
  SELECT template, licence, b, len(w) - 1 AS size, count(*) AS n FROM (
    SELECT template, licence, w, unnest(list_zip(w[:-2], w[2:])) AS b FROM t)
  GROUP BY ALL),
u AS (
  SELECT doc_id, list_zip(w[:-2], w[2:]) AS pairs FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)
  WHERE len(w) > 1),
h AS (
  SELECT doc_id, template, licence, size, n, pos, b
  FROM (SELECT doc_id, unnest(range(len(pairs))) AS pos, unnest(pairs) AS b FROM u) JOIN tb USING (b)),
c AS (
  SELECT p.doc_id, p.template, p.licence, p.size, p.pos, least(count(*), any_value(h.n)) AS common
  FROM h p JOIN h ON p.doc_id = h.doc_id AND p.template = h.template AND h.pos BETWEEN p.pos AND p.pos + p.size - 1
  GROUP BY p.doc_id, p.template, p.licence, p.size, p.pos, h.b),
s AS (
  SELECT doc_id, template, licence, pos, CAST(sum(common) AS DOUBLE) / size AS dice
  FROM c GROUP BY doc_id, template, licence, size, pos)
SELECT doc_id, licence, CAST(template AS INTEGER) AS template, CAST(pos AS INTEGER) AS first_word, dice
FROM s WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, template, pos) = 1
"""
