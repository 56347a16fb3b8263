"""Licence scan, with DataFrame functions only: row by row, no shuffle but the last small grouping.

A text is compared in units: each sentence, each line, each paragraph and the whole text. A unit is normalised to
lower-case words (runs of letters and digits) and matched by the Dice coefficient of its set of word bigrams with
that of each licence template. A Dice coefficient of at least t needs set sizes within a factor (2 - t) / t, so only
templates within these bounds are compared. Before that, texts without any telling word are left out: per template
the words are chosen so that every unit that could reach t has at least one of them, so nothing is lost.

A notice within a longer sentence, or wrapped over the lines of a longer paragraph, is no unit of its own. So the whole
normalised text is also compared in windows of a template's word count that start at one of its bigrams; at
the end of the text the window slides back. Windows stand in where a document has no unit for the template: score,
count and unit are then those of the windows.

Templates are short notices, opening clauses, and whole texts and headers of common licences. A text of one licence can
reach the bound of a relative too, as with two and three clauses; the score tells them apart.

Null and empty texts have no unit. Rows that repeat an id are one document: a licence is given once for an id, with
its best unit; of units of equal score the first in order of text is given. Texts are read whole, however long. Rows
without an id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import column
from cinderlake.llm.licence_texts import TEXTS

LEAST = 0.8
#: Words that most English texts have: they tell little.
EVERYDAY = {"and", "any", "are", "as", "by", "for", "if", "in", "is", "it", "its", "not", "of", "on", "or", "that", "the", "this", "to", "with", "you"}

# Short notices and opening clauses of common licences.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
TEMPLATES = NOTICES | TEXTS


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain_bigrams(text: str) -> list[str]:
    w = plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def telling_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which every unit that reaches ``least`` with a template has one.

    Such a unit shares at least ``least / (2 - least)`` of the template's bigrams. Words are added, longest first and
    everyday ones last, until the bigrams without any of them are fewer than that.
    """
    chosen: set[str] = set()
    for text in templates.values():
        bigrams = plain_bigrams(text)
        need = least / (2 - least) * len(bigrams)
        for w in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w not in chosen, w in EVERYDAY, -len(w), w)):
            if sum(1 for b in bigrams if not chosen & set(b.split())) < need - 1e-9:
                break
            chosen.add(w)
    return sorted(w for w in chosen if not any(v != w and v in w for v in chosen))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def units(text: Column) -> Column:
    """Different normalised sentences, lines, paragraphs and the whole text."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    raw = F.concat(sentences, F.split(text, "\n"), F.split(text, r"\n[ \t]*\n"), F.array(text))
    return F.array_distinct(F.transform(raw, normal))


def bigrams(w: Column) -> Column:
    """Different pairs of neighbouring words; ``w`` must be a column of its own, or each pair would split the text again."""
    pairs = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def windows(rows: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """``(id, unit, m)`` for the windows of ``rows(id, body)`` that reach ``least``; ``m`` is the licence with its score.

    A window that reaches it shares at least ``least / (2 - least)`` of the template's bigrams, so texts with fewer of
    them, and starts with fewer hits behind them, are left out.
    """
    wanted = {name: plain_bigrams(text) for name, text in templates.items()}
    need = {name: math.ceil(least / (2 - least) * len(want) - 1e-9) for name, want in wanted.items()}
    every = sorted({b for want in wanted.values() for b in want})
    split = rows.select("id", F.split(normal(F.col("body")), " ").alias("w"))
    held = split.select("id", "w", F.array_intersect(bigrams(F.col("w")), F.array(*map(F.lit, every))).alias("held"))
    near = []
    for name, want in sorted(wanted.items()):
        found = F.array(*map(F.lit, want))
        t = F.struct(F.lit(name).alias("licence"), found.alias("want"), F.lit(len(plain_words(templates[name]))).alias("n_words"), F.lit(need[name]).alias("need"))
        near.append(F.when(F.size(F.array_intersect("held", found)) >= need[name], t))
    # The outer form: for the other one Spark would add a test for empty arrays, and work them out twice.
    likely = held.select("id", "w", F.explode_outer(F.array_compact(F.array(*near))).alias("t")).where("t IS NOT NULL").select("id", "w", "t.*")
    at = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("want", F.concat_ws(" ", x, F.get("w", i + 1))), i)), lambda i: i.isNotNull())
    hits = likely.withColumn("at", at)
    dense = F.filter("at", lambda p, i: F.get("at", i + F.col("need") - 1) < p + F.col("n_words") - 1)
    last = F.size("w") - F.col("n_words")
    slid = F.when(last >= 0, F.array_distinct(F.transform(dense, lambda p: F.least(p, last))))
    cut = hits.select("id", "licence", "want", F.explode_outer(slid).alias("start"), "w", "n_words").where("start IS NOT NULL")
    cut = cut.select("id", "licence", "want", F.slice("w", F.col("start") + 1, F.col("n_words")).alias("w"))
    sized = cut.select("id", "licence", "want", F.array_join("w", " ").alias("unit"), bigrams(F.col("w")).alias("have"))
    dice = 2.0 * F.size(F.array_intersect("have", "want")) / (F.size("have") + F.size("want"))
    return sized.select("id", "unit", F.struct("licence", dice.alias("score")).alias("m")).where(F.col("m.score") >= least)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, licence, score, n_units, unit)``: licences of each document, with the best unit, normalised."""
    templates = TEMPLATES if templates is None else templates
    known = {name: b for name, text in templates.items() if (b := plain_bigrams(text))}
    body = F.col("body")
    # Short words are parts of many others: they are looked for as whole words, and last.
    words = sorted(telling_words({k: templates[k] for k in known}, least), key=lambda w: (-len(w), w))

    def tells(low: Column) -> Column:
        return reduce(Column.__or__, [low.contains(w) if len(w) > 3 else low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])") for w in words])

    # The text is lower-cased as an element of an array, so once: written out for each word it would be as often as there are words.
    tell = F.exists(F.array(F.lower(body)), tells) if words else F.lit(False)
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("body")).where(tell)
    each = rows.select("id", F.explode(units(body)).alias("unit"))
    likely = None
    for w in telling_words({k: templates[k] for k in known}, least):
        likely = F.col("unit").contains(w) if likely is None else likely | F.col("unit").contains(w)
    each = each.where(likely if likely is not None else F.lit(False)).withColumn("w", F.split("unit", " "))
    sized = each.select("id", "unit", bigrams(F.col("w")).alias("have")).withColumn("n", F.size("have"))
    scored = []
    for name, want in sorted(known.items()):
        low_n, high_n = len(want) * least / (2 - least), len(want) * (2 - least) / least
        dice = 2.0 * F.size(F.array_intersect("have", F.array(*map(F.lit, want)))) / (F.col("n") + len(want))
        scored.append(F.when(F.col("n").between(low_n - 1e-9, high_n + 1e-9), F.struct(F.lit(name).alias("licence"), dice.alias("score"))))
    if not scored:
        return sized.select("id", F.lit("").alias("licence"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_units"), "unit").where("false")
    found = sized.select("id", "unit", F.explode(F.array_compact(F.array(*scored))).alias("m")).where(F.col("m.score") >= least)
    both = found.withColumn("window", F.lit(False)).unionByName(windows(rows, {k: templates[k] for k in known}, least).withColumn("window", F.lit(True)))
    each = both.select("id", "m.licence", "m.score", "window", "unit").distinct()
    best = each.groupBy("id", "licence").agg(F.min(F.struct("window", (-F.col("score")).alias("minus"), "unit")).alias("best"), F.count_if(~F.col("window")).alias("n_whole"), F.count("*").alias("n"))
    n_units = F.when(F.col("best.window"), F.col("n")).otherwise(F.col("n_whole"))
    return best.select("id", "licence", F.round(-F.col("best.minus"), 6).alias("score"), n_units.alias("n_units"), "best.unit")


def oracle(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same result in DuckDB SQL, without telling words."""
    templates = TEMPLATES if templates is None else templates
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {len(plain_words(t))}, [{', '.join(map(quoted, b))}])" for n, t in sorted(templates.items()) if (b := plain_bigrams(t)))
    normal_of = lambda c: rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
WITH t(licence, n_words, want) AS (VALUES {known}),
raw AS (
  SELECT doc_id, unnest(list_concat(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), string_split(text, chr(10)),
         string_split_regex(text, '\n[ \t]*\n'), [text])) AS u FROM documents WHERE text IS NOT NULL
), unit AS (
  SELECT DISTINCT doc_id, {normal_of('u')} AS unit FROM raw
), words AS (
  SELECT doc_id, unit, string_split(unit, ' ') AS w FROM unit
), have AS (
  SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS have FROM words
), m AS (
  SELECT doc_id, unit, licence, false AS in_window, 2.0::DOUBLE * len(list_intersect(have, want)) / (len(have) + len(want)) AS score
  FROM have, t WHERE len(have) BETWEEN len(want) * {least}::DOUBLE / (2 - {least}::DOUBLE) - 1e-9 AND len(want) * (2 - {least}::DOUBLE) / {least}::DOUBLE + 1e-9
), body AS (
  SELECT DISTINCT doc_id, string_split({normal_of('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM body
), gram AS (
  SELECT licence, n_words, unnest(want) AS gram FROM t
), start AS (
  SELECT doc_id, w, licence, n_words, least(p, len(w) - n_words + 1) AS s, count(*) AS hits
  FROM place JOIN gram ON gram = w[p] || ' ' || w[p + 1] WHERE len(w) >= n_words GROUP BY ALL
), win AS (
  SELECT DISTINCT doc_id, licence, w[s : s + n_words - 1] AS w FROM start
), whave AS (
  SELECT doc_id, licence, array_to_string(w, ' ') AS unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS have FROM win
), every AS (
  SELECT * FROM m WHERE score >= {least}::DOUBLE
  UNION ALL SELECT doc_id, unit, licence, true, score FROM (SELECT doc_id, unit, licence, 2.0::DOUBLE * len(list_intersect(have, want)) / (len(have) + len(want)) AS score FROM whave JOIN t USING (licence)) WHERE score >= {least}::DOUBLE
), first AS (
  SELECT *, min(in_window::INT) OVER (PARTITION BY doc_id, licence) AS least_window FROM every
)
SELECT doc_id, licence, round(max(score), 6) AS score, count(DISTINCT (score, unit)) AS n_units, min_by(unit, (-score, unit)) AS unit
FROM first WHERE in_window::INT = least_window GROUP BY doc_id, licence
"""
