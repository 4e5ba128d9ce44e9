"""Licence paragraphs found by a trained classifier over sparse word n-grams and confirmed against templates.

The classifier is a logistic regression for each family over words and pairs of words of a paragraph, trained here on the templates below, their variants and
prose that is no licence; it is small (its features are the n-grams of the training texts), so its weights are known at planning time and join as a bounded table.
An unknown class takes a paragraph whose best calibrated probability is below `least`; the calibration (one scale and one shift per model, fitted on held-out
variants) turns scores into probabilities. A prediction stands only if the paragraph holds the template's words: the share of the template's distinct words that
it has must reach `share`.

A paragraph is a smallest range of neighbouring lines, none of them without a word, that holds the share of one template: a notice in one line, or one that is wrapped over
several. For each line the latest line is known at which each of the template's words stood, so the ranges are found in one pass, however long they are. Ranges of one family that
overlap count as one. Texts are left out early only if they can't reach a share: a template of m words of which k are needed is out of reach without one of any
m - k + 1 of them (`anchors` takes the rarest), and then if the whole text has less than k.

All of it on the main path is DataFrame functions: n-grams of paragraphs are exploded, weights are joined and summed.

Null and empty texts have no paragraphs and give no finding. Texts are scanned whole. Repeated rows repeat their findings in each copy's row; a null doc_id is kept. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import table

# Short forms of public licence notices by family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "mit": ["Released under the MIT License.", "This software is released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd": ["Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "epl": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "boost": ["Distributed under the Boost Software License, Version 1.0."],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved."],
    "public-domain": ["This work is in the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
}
# Identifiers of the short form of a notice, by family.
SPDX = {
    "apache-2.0": ["Apache-2.0"], "mit": ["MIT"], "gpl": ["GPL-2.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"], "agpl": ["AGPL-3.0-only"], "epl": ["EPL-2.0"], "isc": ["ISC"], "mpl": ["MPL-2.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "boost": ["BSL-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "public-domain": ["CC0-1.0", "Unlicense"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _ids]
# Prose that shares words with notices and is none.
OTHER = [
    "The version of the story that was released under a new name is free.", "He was granted permission to use the work of the public house.", "All of the files and the general terms were in the copy room.",
    "You may not redistribute the bread, but you can modify the recipe.", "The rights of the people and the free press are in the public mind.", "This person has a license to drive and a source of income.",
    "The following conditions are met by the software of the foundation.", "The apache helicopter flew under the bridge in the version we saw.", "A common and creative attribution of the work to the author.",
    "The university is known for its domain and its international students.", "The charge was reserved for the copy of the document.", "Der die das und ein nicht mit von dem.", "Le la les de des et une dans pour que.", "El la los de que y en un por con.",
]
# Words that are in most texts, so the last to look for.
COMMON = {*"1 2 3 a an and any are as be by can file form free in is it may met not of or that the this to under use with without work you".split()}
LEAST, SHARE, ROUNDS, RIDGE = 0.6, 0.7, 400, 1e-3


def _forms(share: float) -> list[tuple[str, list[str], int]]:
    """Family, distinct words and the number of them that a paragraph needs, of each template."""
    cut = [(f, sorted({x for x in re.split("[^a-z0-9]+", t.lower()) if x})) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    return [(f, words, next(k for k in range(1, len(words) + 1) if k / len(words) >= share)) for f, words in cut]


def anchors(share: float) -> list[str]:
    """Words of which each paragraph that reaches the share of a template has one: of each template so many of its rarest that those left aren't enough."""
    forms = _forms(share)
    prose = [{x for x in re.split("[^a-z0-9]+", t.lower()) if x} for t in OTHER]
    common = lambda w: (w in COMMON, sum(w in p for p in prose) + sum(w in words for _, words, _ in forms), -len(w), w)
    return sorted({w for _, words, k in forms for w in sorted(words, key=common)[: len(words) - k + 1]})


#: Words that a notice can't do without.
ANCHORS = anchors(SHARE)


def grams(text: str) -> list[str]:
    """Distinct words and pairs of neighbouring words of a text, as `_grams` cuts them in SQL."""
    w = [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def variants(text: str) -> list[str]:
    """Forms in which a notice is met: without its end, without a beginning, after a year and a name, among other words."""
    w = text.split()
    return [text, text.upper(), f"Copyright 2020 The Authors. {text}", f"{text} See the file for details.", " ".join(w[:-1]), " ".join(w[1:]), f"Note: {text}", f"# {text}"]


def train(templates: dict[str, list[str]] = TEMPLATES, other: list[str] = OTHER) -> tuple[dict[tuple[str, str], float], dict[str, float], tuple[float, float]]:
    """Weights by (n-gram, family), intercepts by family, and the calibration (scale, shift)."""
    rows = [(grams(v), family, i % 4 == 3) for family, texts in templates.items() for t in texts for i, v in enumerate(variants(t))]
    rows += [(grams(t), "", i % 4 == 3) for i, t in enumerate(other * 4)]
    families = sorted(templates)
    weights: dict[tuple[str, str], float] = {}
    shift: dict[str, float] = {}
    for family in families:
        own: dict[str, float] = {}
        bias = 0.0
        fit = [(g, 1.0 if f == family else 0.0) for g, f, held in rows if not held]
        for _ in range(ROUNDS // 8):
            for g, y in fit:
                z = bias + sum(own.get(x, 0.0) for x in g) / math.sqrt(len(g) or 1)
                step = 0.5 * (y - 1 / (1 + math.exp(-z)))
                bias += 0.1 * step
                for x in g:
                    own[x] = own.get(x, 0.0) * (1 - RIDGE) + step / math.sqrt(len(g))
        shift[family] = round(bias, 6)
        weights.update(((x, family), round(w, 6)) for x, w in own.items() if abs(w) > 1e-3)
    # Calibration on the rows held out: one scale and shift for all families' scores.
    told = [((shift[f] + sum(weights.get((x, f), 0.0) for x in g) / math.sqrt(len(g) or 1)), 1.0 if f == family else 0.0) for g, family, held in rows if held for f in families]
    a, b = 1.0, 0.0
    for _ in range(ROUNDS):
        ga = gb = 0.0
        for z, y in told:
            e = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, a * z + b))))
            ga, gb = ga + e * z, gb + e
        a, b = a + ga / len(told), b + gb / len(told)
    return weights, shift, (round(a, 6), round(b, 6))


@cache
def _trained():
    return train()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _paragraphs(docs: DataFrame, share: float) -> DataFrame:
    """doc_id, copy (a hash of the text), line and last (of the range of lines) and words of each paragraph that holds the share of a template."""
    forms = _forms(share)
    low = F.lower("text")
    strings = lambda words: F.array(*(F.lit(w) for w in words))
    may = docs.where(low.rlike(f"(?<![a-z0-9])(?:{'|'.join(anchors(share))})(?![a-z0-9])")).select("doc_id", F.xxhash64("text").alias("copy"), low.alias("text"))
    known = F.array_intersect(F.split("text", "[^a-z0-9]+"), strings(sorted({w for _, words, _ in forms for w in words})))
    out_of = lambda known: F.array(*(F.when(F.size(F.array_intersect(known, strings(words))) >= k, F.lit(i)) for i, (_, words, k) in enumerate(forms)))
    # An array of one element names what would be computed several times; explode computes it once and leaves out texts that reach nothing.
    reached = may.select("*", F.explode(F.filter(F.transform(F.array(known), lambda x: F.array_compact(out_of(x))), lambda x: F.size(x) > 0)).alias("forms"))
    each_form = F.array(*(F.struct(strings(words).alias("needed"), F.lit(k).alias("k")) for _, words, k in forms))
    lines = reached.withColumn("reach", F.transform("forms", lambda i: each_form[i])).dropDuplicates(["doc_id", "copy"])
    lines = lines.select("doc_id", "copy", "reach", F.transform(F.split("text", "\n"), _words).alias("lines"))
    numbered = F.transform("lines", lambda words, i: F.struct(i.alias("i"), words.alias("words")))
    none = F.array().cast("array<struct<line:int,last:int>>")

    def ranges(form: Column) -> Column:
        start = F.struct(F.transform(form.needed, lambda _: F.lit(-1)).alias("seen"), none.alias("found"), F.lit(-1).alias("first"))

        def step(state: Column, line: Column) -> Column:
            seen = F.when(F.size(line.words) == 0, F.transform(form.needed, lambda _: F.lit(-1))).otherwise(F.zip_with(state.seen, form.needed, lambda at, w: F.when(F.array_contains(line.words, w), line.i).otherwise(at)))
            passed = F.struct(seen.alias("seen"), F.element_at(F.sort_array(seen, asc=False), form.k).alias("first"))
            return F.transform(F.array(passed), lambda p: F.struct(p.seen.alias("seen"), F.when(p["first"] > state["first"], F.concat(state.found, F.array(F.struct(p["first"].alias("line"), line.i.alias("last"))))).otherwise(state.found).alias("found"), F.greatest(p["first"], state["first"]).alias("first")))[0]

        return F.aggregate(numbered, start, step, lambda state: state.found)

    spans = F.array_distinct(F.flatten(F.transform("reach", ranges)))
    each = F.transform(spans, lambda r: F.struct(r.line.alias("line"), r["last"].alias("last"), F.flatten(F.slice(F.col("lines"), r.line + 1, r["last"] - r.line + 1)).alias("words")))
    return lines.select("doc_id", "copy", F.explode(each).alias("r")).select("doc_id", "copy", "r.*")


def scan(documents: DataFrame, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """doc_id, line and last (of the range of lines), family, probability and the share of the template for each confirmed paragraph; and a row per document by `per_document`."""
    spark = documents.sparkSession
    weights, shift, (a, b) = _trained()
    families = sorted(TEMPLATES)
    weight = spark.createDataFrame([(g, f, w) for (g, f), w in sorted(weights.items())], "gram string, family string, weight double")
    forms = spark.createDataFrame([(f, i, sorted({x for x in re.split("[^a-z0-9]+", t.lower()) if x})) for f in families for i, t in enumerate(TEMPLATES[f])], "family string, form int, needed array<string>")
    bias = spark.createDataFrame(sorted(shift.items()), "family string, bias double")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = _paragraphs(docs, share)
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
    gram = F.array_distinct(F.concat("words", pairs))
    cut = cut.withColumn("grams", gram)
    key = ["doc_id", "copy", "line", "last"]
    scored = cut.select(*key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(weight), "gram")  # the weights are bounded by the training texts above
    scored = scored.groupBy(*key, "family").agg((F.sum("weight") / F.sqrt(F.first("n"))).alias("score")).join(F.broadcast(bias), "family")
    scored = scored.withColumn("probability", 1 / (1 + F.exp(-(F.lit(a) * (F.col("score") + F.col("bias")) + F.lit(b)))))
    best = scored.groupBy(*key).agg(F.max(F.struct(F.col("probability"), F.col("family"))).alias("best")).select(*(F.col(k).alias(f"of_{k}") for k in key), "best.*").where(F.col("probability") >= least)
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    held = cut.select(*key, "words").join(best, same).select(*key, "words", "family", "probability")
    confirmed = held.join(F.broadcast(forms), "family").withColumn("share", F.size(F.array_intersect("words", "needed")) / F.size("needed"))
    return confirmed.groupBy(*key, "family", "probability").agg(F.max("share").alias("share")).where(F.col("share") >= share).select(*key, "family", F.round("probability", 6).alias("probability"), F.round("share", 6).alias("share"))


def per_document(documents: DataFrame) -> DataFrame:
    """Every row of documents: doc_id, families (sorted, distinct; empty if none is known) and n_paragraphs with a confirmed licence."""
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("copy"))
    own = Window.partitionBy("doc_id", "copy", "family").orderBy("line", "last").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("line") > F.max("last").over(own), F.lit(True))  # it overlaps none before it of its family
    found = scan(documents).withColumn("apart", apart).groupBy(F.col("doc_id").alias("of_doc_id"), F.col("copy").alias("of_copy")).agg(F.array_sort(F.collect_set("family")).alias("families"), F.count_if("apart").alias("n_paragraphs"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("copy") == F.col("of_copy")), "left")
    return joined.select("doc_id", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
