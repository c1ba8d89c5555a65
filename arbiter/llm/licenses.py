"""License scan in DataFrame operations only (no Python on executors).

Texts and templates are normalised alike, across line breaks: A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  With B the bag of word bigrams (of a single word: the word itself), a window of words
matches a template where

    dice = 2 |B(window) & B(template)| / (|B(window)| + |B(template)|) >= threshold.

A notice that is wrapped over lines, stands inside a paragraph or is part of a whole licence text is found alike.
Of the windows that begin at one word the best is kept (the shortest of ties), and of those that begin fewer words
apart than the template has bigrams the best is reported (the first of ties).

Size bounds: Dice t needs |B(window)| within [t / (2 - t), (2 - t) / t] of |B(template)|, and at least t / (2 - t) of the
template's bigrams matched.  A template is a candidate for a text that holds so many of its bigrams; a window
begins and ends with one of them (to trim another one raises Dice), and begins only where so many follow within its
largest size.

Before that, texts without any key word leave.  A match shares at least t / (2 - t) of a template's bigrams, so it
holds at least one bigram of any larger part of them; the template's longest words are key words until
their bigrams make up such a part.  No match can be lost by this.  What is shuffled are occurrences of template bigrams in
such texts, a group being one text and template.

Nulls and odd input: a null or empty text has no windows and gives no row; repeated rows and ids each
report their findings; of templates that tie on a window, all are reported; an empty template table
finds nothing; extra columns have no influence; a text of any length is searched whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm.decontaminate import exact_words
from arbiter.llm.registry import query
from arbiter.llm.tables import broadcast_checked, load, once

THRESHOLD, MAX_LITERALS = 0.75, 50_000

# Notice texts of public licences (identifier, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if rows is None else rows, "license string, template string")


def _grams(words: str, single: bool) -> str:
    """Word bigrams of an array of words, in order; of one word, if ``single``, the word itself."""
    pairs = f"transform(sequence(0, size({words}) - 2), i -> concat_ws(' ', {words}[i], {words}[i + 1]))"
    return f"if(size({words}) < 2, {words if single else 'array()'}, {pairs})"


def template_grams(notices: DataFrame, threshold: float, text: str = "template") -> DataFrame:
    """(license, template, gram, c, n, least, hi, single): each template's bigrams with their number, and its size bounds."""
    t = notices.select("license", F.col(text).alias("template"), exact_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    t = t.where("size(w) > 0").select("license", "template", F.expr(_grams("w", True)).alias("tb"), F.expr("size(w) = 1").alias("single"))
    part = threshold / (2 - threshold)
    t = t.select("license", "template", "tb", "single", F.expr("size(tb)").alias("n"), F.expr(f"cast(ceil(size(tb) * {part!r} - 1e-9) as int)").alias("least"),
                 F.expr(f"if(single, 1, cast(floor(size(tb) * {1 / part!r} + 1e-9) as int))").alias("hi"))
    keys = ["license", "template", "n", "least", "hi", "single"]
    return t.dropDuplicates(["license", "template"]).select(*keys, F.explode("tb").alias("gram")).groupBy(*keys, "gram").agg(F.count("*").cast("int").alias("c"))


def key_words(notices: DataFrame, threshold: float, text: str = "template") -> list[str]:
    """Words, in upper case, of which every passage at the threshold holds one (see above)."""
    found: set[str] = set()
    for (w,) in notices.select(exact_words(F.coalesce(F.col(text), F.lit(""))).alias("w")).distinct().collect():
        grams = {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
        part = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9) + 1
        picked: set[str] = set()
        for word in sorted(set(w), key=lambda x: (-len(x), x)):
            if sum(1 for g in grams if picked & set(g)) >= part:
                break
            picked.add(word)
        found |= picked
    return sorted(found)


def scan_licenses(docs: DataFrame, notices: DataFrame, threshold: float = THRESHOLD, max_broadcast: int = 100_000) -> DataFrame:
    """(doc_id, start_word, end_word, license, template, dice): the best windows at or above the threshold (see above).

    Words are counted from 0 in the normalised text, the end exclusive.
    """
    grams = template_grams(notices, threshold)
    keys = key_words(notices, threshold)
    if not keys:
        return docs.sparkSession.createDataFrame([], "doc_id long, start_word int, end_word int, license string, template string, dice double")
    docs = docs.where(F.expr("exists(transform(array(upper(text)), u -> " + " or ".join(f"contains(u, upper('{k}'))" for k in keys) + "), x -> x)"))
    words = once(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), w=exact_words(F.col("text"))).drop("text")
    words = words.withColumn("_row", F.monotonically_increasing_id())
    some = [r.gram for r in grams.select("gram").distinct().limit(MAX_LITERALS + 1).collect()]
    places = []
    if any(" " in g for g in some) or len(some) > MAX_LITERALS:
        places.append(F.transform(F.expr(_grams("w", False)), lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))))
    if any(" " not in g for g in some) or len(some) > MAX_LITERALS:
        places.append(F.transform("w", lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))))
    if len(some) <= MAX_LITERALS:  # a literal hash set; beyond it the join alone finds them
        places = [F.filter(x, lambda h: h["gram"].isin(some)) for x in places]
    hits = words.select("_row", "doc_id", F.explode(F.concat(*places) if len(places) > 1 else places[0]).alias("x"))
    hits = hits.select("_row", "doc_id", "x.pos", "x.gram").join(broadcast_checked(grams, max_broadcast), "gram")
    group = ["_row", "doc_id", "license", "template", "n", "least", "hi", "single"]
    found = hits.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos", "gram", "c"))).alias("h")).where("size(h) >= least")
    # starts of which so many bigrams follow within the largest size
    starts = found.select(*group, "h", F.explode(F.expr(
        "filter(sequence(0, size(h) - least), a -> h[a + least - 1].pos - h[a].pos < hi)")).alias("a"))
    starts = once(starts, g=F.expr("filter(slice(h, a + 1, hi), x -> x.pos - h[a].pos < hi)")).drop("h")
    matched = ("size(array_distinct(transform(slice(g, 1, b), x -> x.gram))) + aggregate(array_distinct(filter(slice(g, 1, b), x -> x.c > 1)."
               "gram), 0, (s, y) -> s + least(size(filter(slice(g, 1, b), x -> x.gram = y)), filter(g, x -> x.gram = y)[0].c) - 1)")
    ends = F.expr(f"transform(sequence(least, size(g)), b -> struct(2D * ({matched}) / (g[b - 1].pos - g[0].pos + 1 + n) as dice, -g[b - 1].pos as back))")
    best = once(starts, e=F.array_max(ends)).where(F.col("e.dice") >= threshold - 1e-12)
    best = best.select("_row", "doc_id", "license", "template", "n", "single", F.expr("g[0].pos").alias("start"), F.expr("-e.back").alias("last"), "e.dice")
    # starts fewer than n apart compete; divided by n they are less than 1 apart
    best = best.withColumn("top", F.expr(
        "max(struct(dice, -start as first)) over (partition by _row, license, template order by start / n "
        "range between 0.9999999D preceding and 0.9999999D following)"))
    best = best.where("top.dice = dice and top.first = -start")
    return best.select("doc_id", F.col("start").alias("start_word"), F.expr("last + if(single, 1, 2)").alias("end_word"),
                       "license", "template", "dice")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in TEMPLATES)
    words = (r"list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT license, template, {grams} AS tb FROM (SELECT license, template, {words.format(x='template')} AS w
    FROM (VALUES {values}) v(license, template))),
tg AS (SELECT license, template, n, gram, count(*) AS c FROM (SELECT license, template, len(tb) AS n, unnest(tb) AS gram FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format(x='text')} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT r, doc_id, unnest(gs) AS gram, generate_subscripts(gs, 1) - 1 AS pos FROM (SELECT r, doc_id, {grams} AS gs FROM d WHERE len(w) > 1)),
h AS MATERIALIZED (SELECT r, doc_id, license, template, n, c, dg.gram, pos FROM dg JOIN tg ON dg.gram = tg.gram),
ab AS (SELECT a.r, a.doc_id, a.license, a.template, a.n, a.pos AS s, b.pos AS e FROM h a JOIN h b
    ON a.r = b.r AND a.license = b.license AND a.template = b.template AND b.pos >= a.pos AND (b.pos - a.pos + 1) <= a.n / {THRESHOLD / (2 - THRESHOLD)!r} + 1e-9),
m AS (SELECT r, doc_id, license, template, n, s, e, sum(least(k, c)) AS matched FROM (
    SELECT ab.r, ab.doc_id, ab.license, ab.template, ab.n, s, e, h.gram, h.c, count(*) AS k FROM ab JOIN h
    ON ab.r = h.r AND ab.license = h.license AND ab.template = h.template AND h.pos BETWEEN s AND e GROUP BY ALL) GROUP BY ALL),
q AS (SELECT *, 2.0::DOUBLE * matched::DOUBLE / (e - s + 1 + n) AS dice FROM m),
z AS (SELECT * FROM q WHERE dice >= {THRESHOLD} - 1e-12 QUALIFY row_number() OVER (PARTITION BY r, license, template, s ORDER BY dice DESC, e) = 1)
SELECT doc_id, CAST(s AS BIGINT) AS start_word, CAST(e + 2 AS BIGINT) AS end_word, license, template, CAST(round(dice, 6) AS DOUBLE) AS dice FROM z
WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.r = z.r AND y.license = z.license AND y.template = z.template AND abs(y.s - z.s) < z.n
    AND (y.dice > z.dice OR (y.dice = z.dice AND y.s < z.s)))
"""


@query("op10_licenses", _sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against the notices above."""
    found = scan_licenses(load(spark, sf_dir, "documents"), templates(spark))
    return found.select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"),
                        "license", "template", F.round("dice", 6).alias("dice"))
