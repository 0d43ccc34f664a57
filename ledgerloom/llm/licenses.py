"""Operator 4, license scans: a positional index of rare licence words."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, others

#: What stands between words. Words are runs of 0-9, letters of either case and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A label, the key phrase that must stand word for word, the words that usually stand before and after it, and the
    licence that it speaks of: the template of that licence with the most words is the licence's full text."""

    label: str
    licence: str
    phrase: str
    before: str = ""
    after: str = ""
    base: bool = False

    def words(self) -> list[str]:
        return [*self.before.split(), *self.phrase.split(), *self.after.split()]

    def mandatory(self) -> range:
        n = len(self.before.split())
        return range(n, n + len(self.phrase.split()))


MIT_AFTER = """to any person obtaining a copy of this software and associated documentation files the software to deal in the
software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied"""
BSD_AFTER = """with or without modification are permitted provided that the following conditions are met 1 redistributions of
source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions
in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution"""
APACHE_AFTER = """version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy
of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied"""
GPL_AFTER = """as published by the free software foundation either version 3 of the license or at your option any later version
this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
of merchantability or fitness for a particular purpose"""
ISC_AFTER = """and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
all warranties with regard to this software including all implied warranties of merchantability and fitness"""
MPL_AFTER = """v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""
UNLICENSE_AFTER = """released into the public domain anyone is free to copy modify publish use compile sell or distribute this
software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""

TEMPLATES = (
    Template("mit", "mit", "mit license", base=True),
    Template("apache", "apache", "apache license", base=True),
    Template("gpl", "gpl", "general public license", base=True),
    Template("agpl", "agpl", "affero general public license"),
    Template("lgpl", "lgpl", "lesser general public license"),
    Template("mpl", "mpl", "mozilla public license"),
    Template("epl", "epl", "eclipse public license"),
    Template("bsd", "bsd", "bsd license"),
    Template("isc", "isc", "isc license"),
    Template("cc-by", "cc-by", "creative commons attribution"),
    Template("spdx", "spdx", "spdx license identifier"),
    Template("mit-text", "mit", "permission is hereby granted free of charge", after=MIT_AFTER),
    Template("bsd-text", "bsd", "redistribution and use in source and binary forms", after=BSD_AFTER),
    Template("apache-2.0", "apache", "licensed under the apache license", after=APACHE_AFTER),
    Template("gpl-text", "gpl", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it", GPL_AFTER),
    Template("isc-text", "isc", "permission to use copy modify", after=ISC_AFTER),
    Template("mpl-text", "mpl", "subject to the terms of the mozilla public license", "this source code form is", MPL_AFTER),
    Template("unlicense", "unlicense", "this is free and unencumbered software", after=UNLICENSE_AFTER),
)

#: A template is found where its phrase stands and words of at least this share of its weight stand at their places.
LEAST_SHARE = 0.6


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased. Splitting takes time in proportion to the text; extracting all matches doesn't."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def word_weights(docs: DataFrame, text_col: str, templates: Sequence[Template]) -> dict[str, int]:
    """IDF over all documents of each word of the templates, in thousandths, 1 at least. The result is as large as that
    vocabulary; whole numbers, so that sums of them don't depend on their order."""
    vocabulary = sorted({w for t in templates for w in t.words()})
    held = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)  # every document holds the empty word once
    return {w: max(1, math.floor(1000 * math.log((1 + total) / (1 + counts.get(w, 0))) + 0.5)) for w in vocabulary}


def index_places(t: Template, weights: Mapping[str, int]) -> list[int]:
    """The places of a template whose words are looked up, by falling IDF: so many that a document in which words of
    LEAST_SHARE of the weight stand must have two of them at least. A template that is but its phrase needs one."""
    words = t.words()
    order = sorted(range(len(words)), key=lambda j: (-weights[words[j]], j))
    if len(words) == len(t.mandatory()):
        return order[:1]
    spare, held = (1 - LEAST_SHARE) * sum(weights[w] for w in words), 0
    for k, j in enumerate(order):
        held += weights[words[j]]
        if held - weights[words[order[0]]] > spare:  # also without the weightiest of them
            return order[: k + 1]
    return order


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES, weights: Mapping[str, int] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    The index posts, for the words of the highest IDF in the corpus, the templates that hold them and where. A file's
    places of these words are looked up in one pass over its words; each posting gives a template and the place where it
    would start, and templates with enough postings of one start (see index_places) are verified there: the key phrase
    must stand, and words of LEAST_SHARE of the template's IDF at their places. No place that meets this is missed, as the
    words that aren't indexed weigh too little. Everything happens within a row: nothing is shuffled but the document
    frequencies of the templates' words.

    score is the largest share, by IDF, of a licence's full text that stands somewhere; a bare name is a small share of a
    licence whose text is known. Defined cases: null text is an empty text; a text without words has n_words 0, null
    first_word and last_word and empty labels; a very long text is scanned whole, in one row of memory; repeated rows and
    null ids stay as they are; an empty table gives an empty one; other columns pass through, but for those named as the
    results.
    """
    weights = word_weights(docs, text_col, templates) if weights is None else weights
    full = {t.licence: max(sum(weights[w] for w in u.words()) for u in templates if u.licence == t.licence) for t in templates}
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for j in index_places(t, weights):
            postings.setdefault(t.words()[j], []).append((k, j))
    index = sorted(postings)
    posted = F.create_map(*[x for w in index for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(j).alias("j")) for k, j in postings[w]]))])
    # A start is before the text's first word at most by a template's length; shifted, it is never negative.
    longest = max(len(t.words()) for t in templates)
    needed = F.array(*[F.lit(1 if len(t.words()) == len(t.mandatory()) else 2) for t in templates])
    spelled = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(weights[w]).alias("x"), F.lit(j in t.mandatory()).alias("must")) for j, w in enumerate(t.words())]) for t in templates])
    totals = F.array(*[F.lit(sum(weights[w] for w in t.words())) for t in templates])
    wholes = F.array(*[F.lit(full[t.licence]) for t in templates])

    def verified(words: Column, starts: Column) -> Column:
        def one(c: Column) -> Column:
            t, at = F.shiftright(c, 40).cast("int"), (c.bitwiseAND((1 << 40) - 1) - longest).cast("int")
            stands = lambda s, j: F.coalesce(F.when(at + j >= 0, F.get(words, at + j)) == s["w"], F.lit(False))
            own = F.get(spelled, t)
            phrase = ~F.exists(F.transform(own, lambda s, j: s["must"] & ~stands(s, j)), lambda x: x)
            held = F.aggregate(F.transform(own, lambda s, j: F.when(stands(s, j), s["x"]).otherwise(0)), F.lit(0), lambda a, b: a + b)
            return F.when(phrase & (held >= LEAST_SHARE * F.get(totals, t)), F.struct(t.alias("t"), at.alias("at"), held.alias("held")))

        return F.array_compact(F.transform(starts, one))

    def looked_up(words: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(index))
        each = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(posted, F.get(words, i)), lambda p: F.shiftleft(p["t"].cast("long"), 40) + (i - p["j"] + longest))))
        enough = lambda s: F.filter(s, lambda c, k: (F.get(s, k - 1).isNull() | (F.get(s, k - 1) != c)) & ((F.get(needed, F.shiftright(c, 40).cast("int")) == 1) | (F.get(s, k + 1) == c)))
        starts = F.transform(F.array(F.sort_array(each)), enough)[0]
        return F.struct(F.size(words).alias("n"), verified(words, starts).alias("found"))

    scanned = docs.withColumn("_scan", F.transform(F.array(words_of(F.col(text_col))), looked_up)[0])
    is_base = F.array(*[F.lit(t.base) for t in templates])
    names = F.array(*[F.lit(t.label) for t in templates])
    base = F.transform(F.filter(F.col("_scan.found"), lambda x: F.get(is_base, x["t"])), lambda x: x["at"])
    labels = lambda only: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.col("_scan.found"), lambda x: F.get(is_base, x["t"]) | F.lit(not only)), lambda x: F.get(names, x["t"])))), ",")
    share = F.array_max(F.transform(F.col("_scan.found"), lambda x: x["held"] / F.get(wholes, x["t"])))
    return scanned.withColumn("_base", base).select(
        *others(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"),
        F.col("_scan.n").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        labels(True).alias("base_labels"),
        labels(False).alias("labels"),
        F.coalesce(share, F.lit(0.0)).alias("score"),
    )
