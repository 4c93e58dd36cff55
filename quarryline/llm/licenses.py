"""License scan: phrases at word positions, and an exact set-similarity join of text blocks
with license templates.

A block (a line; for long templates also a paragraph, for short ones any run of as many words as
the notice has and in its order, across line ends) matches a template T when at least
`containment` of T's distinct words occur in it, that is, an overlap of o = ceil(containment
* |T|) words. Words are ordered by their frequency in the whole corpus, rarest first. Two
sets with such an overlap share a word among T's first |T| - o + 1 (prefix filter), the block
has at least o words (length filter), and behind the first shared word both sides still have
words enough (positional filter). What is left is verified, so the join is exact.

Only templates and their words are broadcast; their number is fixed by TEMPLATES.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, text_or_empty

#: What doesn't belong to a word, once A-Z are lower case.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words stand consecutively, and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

CONTAINMENT = 0.9
#: A template of fewer distinct words is looked for in lines and in runs of words, not in
#: paragraphs: a long one may hold its words by chance.
LONG_TEMPLATE = 20

#: (label, notice): wording of public licenses' own notices (fixed values).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT license"),
    ("mit", "Licensed under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the GNU Lesser General Public License, version"),
    ("agpl", "licensed under the GNU Affero General Public License, version"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_rows(templates=TEMPLATES, containment: float = CONTAINMENT) -> list[tuple]:
    """(template, label, words, size, least) of each template; least is the overlap needed."""
    rows = []
    for i, (label, notice) in enumerate(templates):
        words = sorted({w for w in re.split("[^a-z0-9]+", notice.lower()) if w})
        rows.append((i, label, words, len(words), math.ceil(containment * len(words) - 1e-9)))
    return rows


def notice_words(notice: str) -> list[str]:
    """The words in order, repeated ones too."""
    return [w for w in re.split("[^a-z0-9]+", notice.lower()) if w]


def lowered(text: str | Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    t = text_or_empty(text)
    ascii_only = F.octet_length(t) == F.length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _spaced(text: Column) -> Column:
    """Words with one space between; lines stay apart."""
    return F.regexp_replace(lowered(text), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _frequencies(spaced: DataFrame, words: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first; as many rows as words were declared."""
    spark = spaced.sparkSession
    known = spark.createDataFrame([(w,) for w in words], "word string")
    each = spaced.select(F.explode(F.split("_spaced", "[ \n]")).alias("word"))
    counts = each.join(F.broadcast(known), "word", "left_semi").groupBy("word").count()
    found = known.join(F.broadcast(counts), "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    return [r["word"] for r in found.orderBy("n", "word").collect()]


def license_blocks(rows: DataFrame, templates: DataFrame, index: DataFrame, ranks: DataFrame) -> DataFrame:
    """row_no, label, containment of each block and template that match, once per row and template."""
    block = rows.select("row_no", F.posexplode("blocks").alias("block", "b")).select("row_no", "block", F.col("b.whole").alias("whole"), F.array_distinct("b.words").alias("words"))
    ranked = block.select("row_no", "block", "whole", F.explode("words").alias("word"), F.size("words").alias("n_words")).join(F.broadcast(ranks), "word")
    in_block = Window.partitionBy("row_no", "block")
    placed = ranked.select(
        "row_no", "block", "whole", "n_words", "word",
        F.row_number().over(in_block.orderBy("rank")).alias("at"),
        F.count(F.lit(1)).over(in_block).alias("n_known"),
        F.array_sort(F.collect_list("word").over(in_block)).alias("known"),
    )
    met = placed.join(F.broadcast(index), "word").filter(
        (F.col("n_words") >= F.col("least"))
        & (F.lit(1) + F.least(F.col("n_known") - F.col("at"), F.col("size") - F.col("position")) >= F.col("least"))
        & (~F.col("whole") | (F.col("size") >= LONG_TEMPLATE))
    )
    pairs = met.dropDuplicates(["row_no", "block", "template"]).join(F.broadcast(templates.select("template", "label", "words")), "template")
    overlap = F.size(F.array_intersect("known", "words"))
    found = pairs.withColumn("overlap", overlap).filter("overlap >= least")
    return found.groupBy("row_no", "label").agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays, by rows of the usual table."""
    at = F.sequence(F.lit(1), F.size(b))

    def row(last: Column, w: Column) -> Column:
        own = F.transform(at, lambda i: F.when(F.get(b, i - 1) == w, F.get(last, i - 1) + 1).otherwise(F.get(last, i)))
        return F.concat(F.array(F.lit(0)), F.transform(at, lambda i: F.array_max(F.slice(own, F.lit(1), i))))

    return F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row, lambda last: F.array_max(last))


def _runs(words: Column, short: list[tuple]) -> Column:
    """(template, overlap) where a run of a notice's length holds enough of its words in order,
    so that the end of one notice and the start of the next aren't a third.

    short: (template, words, least, notice, length, prefix) of each template. Every such run holds a
    prefix word, so only runs around one are looked at; run by run only where all of them
    together hold enough.
    """
    texts = lambda xs: F.array(*map(F.lit, xs))
    fields = ("template", "words", "least", "notice", "length", "prefix")
    listed = F.array(*[F.struct(*[(texts(x) if isinstance(x, list) else F.lit(x)).alias(f) for f, x in zip(fields, t, strict=True)]) for t in short])
    rare = sorted({w for t in short for w in t[5]})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())

    def around(p: Column, t: Column) -> Column:
        first = F.greatest(p["at"] + 2 - t["length"], F.lit(1))
        return F.slice(words, first, p["at"] + t["length"] - first + 1)

    def best(near: Column, t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(near) - t["length"] + 1, F.lit(1))), lambda s: F.slice(near, s, t["length"]))
        overlap = lambda run: F.size(F.array_intersect(run, t["words"]))
        missing = F.size(t["words"]) - t["least"]
        ordered = lambda run: F.when(overlap(run) >= t["least"], t["length"] - _common(run, t["notice"]) <= missing).otherwise(False)
        return F.array_max(F.transform(F.filter(runs, ordered), overlap))

    def of_place(p: Column) -> Column:
        enough = lambda t: F.array_contains(t["prefix"], p["word"]) & (F.size(F.array_intersect(around(p, t), t["words"])) >= t["least"])
        met = F.transform(F.filter(listed, enough), lambda t: F.struct(t["template"].alias("template"), best(around(p, t), t).alias("overlap"), t["least"].alias("least")))
        return F.filter(met, lambda x: x["overlap"] >= x["least"])

    return F.array_distinct(F.flatten(F.transform(places, of_place)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row.

    Null text counts as empty: no words, no labels, score 0. Rows that repeat a doc_id are
    scanned each for itself. score is 1 where a phrase stands, else the largest containment
    of a template that matches, else 0. Blocks are lines, for long templates also paragraphs
    (parted by blank lines), and for short ones runs of the notice's number of words.
    """
    spark: SparkSession = docs.sparkSession
    listed = template_rows(templates, containment)
    vocabulary = sorted({w for r in listed for w in r[2]})
    source = docs.select(F.col("doc_id"), F.col(text).alias("_text"))
    spaced = source.select("doc_id", _spaced(F.col("_text")).alias("_spaced"))
    order = {w: i for i, w in enumerate(_frequencies(spaced, vocabulary))}

    index_rows, prefix, short = [], set(), []
    for template, _, words, size, least in listed:
        ordered = sorted(words, key=order.__getitem__)
        for position, w in enumerate(ordered[: size - least + 1], 1):
            index_rows.append((w, template, position, size, least))
            prefix.add(w)
        if size < LONG_TEMPLATE:
            short.append((template, words, least, notice_words(templates[template][1]), len(notice_words(templates[template][1])), ordered[: size - least + 1]))
    index = spark.createDataFrame(index_rows, "word string, template int, position int, size int, least int")
    ranks = spark.createDataFrame(list(order.items()), "word string, rank int")
    table = spark.createDataFrame(listed, "template int, label string, words array<string>, size int, least int")

    rare = F.array(*map(F.lit, sorted(prefix)))
    lines = F.transform(F.split("_spaced", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), _words(x).alias("words")))
    paragraphs = F.when(
        F.col("_spaced").rlike("\n"),
        F.transform(F.split("_spaced", "\n[ \n]*\n"), lambda x: F.struct(F.lit(True).alias("whole"), F.array_distinct(_words(F.translate(x, "\n", " "))).alias("words"))),
    ).otherwise(F.array().cast("array<struct<whole:boolean,words:array<string>>>"))
    # a prefix word must stand in the block; most texts have none at all
    any_rare = F.concat(F.lit(" "), F.translate("_spaced", "\n", " "), F.lit(" ")).rlike(" (?:" + "|".join(sorted(prefix)) + ") ")
    blocks = F.when(any_rare, F.filter(F.concat(lines, paragraphs), lambda b: F.arrays_overlap(b["words"], rare)))

    flat = F.trim(F.regexp_replace("_spaced", "[ \n]+", " "))
    padded = spaced.select("doc_id", blocks.alias("blocks"), flat.alias("flat"), F.col("_spaced").contains("\n").alias("wrapped"))
    holds = {p: F.concat(F.lit(" "), F.col("flat"), F.lit(" ")).contains(f" {p} ") for p in PHRASES}
    words, n_all = F.col("all_words"), F.size("all_words")

    def starts(phrase: str) -> Column:
        parts = phrase.split()
        same = lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)])
        return F.when(F.col(f"has_{PHRASES[phrase]}"), F.filter(F.sequence(F.lit(0), n_all - 1), same)).otherwise(F.array().cast("array<int>"))

    some = _any([F.col(f"has_{x}") for x in PHRASES.values()])
    # within one line a run has no words that the line hasn't
    none = F.array().cast("array<string>")
    run_words = F.when(F.col("wrapped") & (F.size("blocks") > 0), F.split("flat", " ")).otherwise(none) if short else none
    marked = padded.select("doc_id", "blocks", "flat", run_words.alias("run_words"), *[h.alias(f"has_{PHRASES[p]}") for p, h in holds.items()])
    marked = marked.withColumn("n_words", F.when(F.col("flat") == "", 0).otherwise(F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) + 1).cast("long"))
    marked = marked.withColumn("all_words", F.when(some, F.split("flat", " ")).otherwise(F.array().cast("array<string>")))
    marked = marked.withColumn("places", F.when(some, F.concat(*map(starts, PHRASES))).otherwise(F.array().cast("array<int>")))
    base = F.filter(F.array(*[F.when(F.col(f"has_{x}"), x) for x in PHRASES.values()]), lambda x: x.isNotNull())
    rows = marked.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"), "blocks",
        (_runs(F.col("run_words"), short) if short else F.array().cast("array<struct<template:int,overlap:int,least:int>>")).alias("runs"),
    )
    rows = materialize(rows, "licenses")
    found = license_blocks(rows.select("row_no", "blocks"), table, index, ranks)
    runs = rows.select("row_no", F.explode("runs").alias("run")).select("row_no", F.col("run.template").alias("template"), F.col("run.overlap").alias("overlap"))
    runs = runs.join(F.broadcast(table.select("template", "label", "size")), "template")
    found = found.unionByName(runs.select("row_no", "label", (F.col("overlap") / F.col("size")).alias("containment")))
    own = found.groupBy(F.col("row_no").alias("_row")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    joined = rows.drop("blocks", "runs").join(own, F.col("row_no") == F.col("_row"), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("best"), F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _all(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out & x
    return out


def _any(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out
