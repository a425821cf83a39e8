"""License scans by diagonal voting, in DataFrame functions only.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing. (Unicode's lower-casing splits and matches the same here:
characters beyond ASCII are word characters before and after, and none becomes a whole word of a phrase.)

Base labels: the places where a phrase's words stand consecutively.

The method's labels: every run of K words of every text is hashed and joined to the places of the same runs in license
templates, whose number is fixed in this module, so they are broadcast. Runs that begin, go on or end with a word that no
template has there are left out before rows are made of the others, so texts are read once and few rows follow. The runs'
words are compared too. A match at text word i and template word j votes for diagonal i - j; votes are collected by text,
template and diagonal. Diagonals of one template that lie at most SLACK apart are merged, since an inserted or deleted word
moves the rest to a neighbouring diagonal. A merged span is verified: it must cover at least COVER of the template's runs,
each counted once, within at most STRETCH times the template's length. Copies of a short template in a row have diagonals as
near as that too, so every run of diagonals that starts at one of them and is at most SLACK wide is verified as well as the
merged span. The label of a verified template is added; a general notice that lies within a longer match of the same family
is one more label, not a contradiction.

Null texts are empty, without words; an empty table gives an empty result; other columns are not read, so their names can't
clash. Repeated rows give equal rows, and their votes count once. A text that repeats a template many times votes on as many
diagonals, each with at most as many votes as the template has runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_or_shuffled

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run; votes are for runs of this many words.
K = 4
SLACK, COVER, STRETCH = 6, 0.6, 1.5
# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Public license notices by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), BETWEEN), "")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _starts(w: Column, at_place: list[list[str]]) -> Column:
    """The places in w from which on the words are among those that are listed for each next place."""
    n = len(at_place)
    fits = lambda i: _all([F.get(w, i + F.lit(k)).isin(*x) for k, x in enumerate(at_place)])
    return F.when(F.size(w) >= n, F.filter(F.sequence(F.lit(0), F.size(w) - n), fits)).otherwise(F.array().cast("array<int>"))


def _template_words() -> list[tuple[int, str, list[str]]]:
    split = re.compile(BETWEEN)
    return [(i, label, [w for w in split.split(text.lower()) if w]) for i, (label, text) in enumerate((k, t) for k, ts in TEMPLATES.items() for t in ts)]


def templates(spark) -> DataFrame:
    """(h, run, template, label, at, runs): every run of K words of every template; a few hundred rows."""
    rows = [(i, label, at, len(w) - K + 1, w[at : at + K]) for i, label, w in _template_words() for at in range(len(w) - K + 1)]
    t = spark.createDataFrame(rows, "template int, label string, at int, runs int, run array<string>")
    return t.withColumn("h", F.xxhash64(*[F.get("run", F.lit(k)) for k in range(K)]))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, _qs_th, n_words, the base columns, and hits: (i, h, run) of the runs of K words that may be in a template."""
    at_place = [sorted({w[at + k] for _, _, w in _template_words() for at in range(len(w) - K + 1)}) for k in range(K)]
    each = docs.select("doc_id", F.xxhash64("text").alias("_qs_th"), words("text").alias("w"))
    each = each.select("doc_id", "_qs_th", "w", _starts(F.col("w"), at_place).alias("_runs"), _starts(F.col("w"), [sorted({p.partition(" ")[0] for p in PHRASES})]).alias("_heads"))
    run = lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get("w", i + F.lit(k)) for k in range(K)]).alias("h"), F.slice("w", i + 1, K).alias("run"))
    there = lambda p: lambda i: _all([F.get("w", i + F.lit(k)).eqNullSafe(F.lit(x)) for k, x in enumerate(p.split(" "))])
    places = {label: F.filter("_heads", there(p)) for p, label in PHRASES.items()}
    each = each.select("doc_id", "_qs_th", F.size("w").cast("long").alias("n_words"), F.transform("_runs", run).alias("hits"), *[x.alias(label) for label, x in places.items()])
    every = F.concat(*PHRASES.values())
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(x)) for x in PHRASES.values()])))
    return each.select("doc_id", "_qs_th", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"), "hits")


def matches(each: DataFrame) -> DataFrame:
    """(doc_id, _qs_th, template, label, first, last, cover): verified spans of template matches, in words. each: texts()."""
    hits = each.where(F.size("hits") > 0).select("doc_id", "_qs_th", F.inline("hits")).withColumnRenamed("run", "_run")
    hits = hits.join(F.broadcast(templates(each.sparkSession)), "h").where(F.col("_run") == F.col("run"))
    # the places of a diagonal as a set: a repeated row's votes are the same ones
    votes = hits.groupBy("doc_id", "_qs_th", "template", "label", "runs", (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("js"), F.min("i").alias("first"), F.max("i").alias("last"))
    order = Window.partitionBy("doc_id", "_qs_th", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(1))
    merged = votes.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order))
    span = lambda over: F.struct(*[over(x).alias(n) for x, n in ((F.collect_list("js"), "js"), (F.min("first"), "first"), (F.max("last"), "last"))])
    by = ["doc_id", "_qs_th", "template", "label", "runs"]
    spans = merged.groupBy(*by, "group").agg(span(lambda x: x).alias("s")).select(*by, "s")
    # copies of a short template in a row merge into one span that is too long: each diagonal with its next ones is a span too
    near = F.array(*[span(lambda x, w=w: x.over(order.rangeBetween(0, w))) for w in range(SLACK + 1)])
    spans = spans.unionByName(merged.withColumn("near", near).select(*by, F.explode("near").alias("s")))
    spans = spans.select(*by, "s.first", (F.col("s.last") + K).alias("last"), (F.size(F.array_distinct(F.flatten("s.js"))) / F.col("runs")).alias("cover"))
    return spans.where((F.col("cover") >= COVER) & (F.col("last") - F.col("first") <= STRETCH * (F.col("runs") + K - 1)))


def scan(docs: DataFrame) -> DataFrame:
    """docs' rows with n_words, n_base, first_word, last_word, base_labels, labels, score; other columns are left out."""
    each = cut(texts(docs))
    found = matches(each).groupBy(F.col("doc_id").alias("_qs_id"), F.col("_qs_th").alias("_qs_h")).agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    joined = each.join(small_or_shuffled(cut(found), 200), (F.col("_qs_th") == F.col("_qs_h")) & F.col("doc_id").eqNullSafe(F.col("_qs_id")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
