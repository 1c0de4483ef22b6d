"""Licence scans: a trained paragraph classifier of word n-grams, with a calibrated unknown class and a template comparison.

A sparse logistic regression (softmax over licence families and "none"; proximal steps keep few n-grams) is trained on the
driver from the notices below and ordinary sentences, with words dropped, added and cut. Leaving out one family at a time
gives the calibration: how sure the model is of a licence it never saw, from which follows how sure it must be of a
known one; what is surely a licence but of no family for sure is "unknown". A prediction is confirmed if the paragraph
holds enough of the words of one of its family's notices, or consists of such words.

The corpus side is DataFrame functions alone. A notice may be wrapped, so that a paragraph is a run of lines, unbroken by
a blank line, that each hold LEAST_ANCHORS or more of the model's anchor words (see ``paragraphs``); other lines belong to no notice. Only n-grams
with an anchor word have weights. The paragraphs, a small part of the texts, are written once; their n-grams meet the weights in
a broadcast join: the model has at most MOST_FEATURES rows, whatever the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut
from .text import table

# Notices by which licences are granted, by family.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may share and adapt this material for noncommercial purposes with attribution under CC BY-NC.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License CC BY.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
        "All rights reserved.",
    ],
}
# Ordinary sentences, some with words that notices use as well.
ORDINARY = [
    "He lost his driving license on the way to the public library.",
    "The general asked for a copy of the map and a version of the plan.",
    "She works at the institute in the city and writes software for banks.",
    "The committee granted permission for the march in the centre of the town.",
    "Please read the following conditions before you use the pool.",
    "They released a new album under a different name last year.",
    "The commons behind the church are open to the public at all hours.",
    "This work took them three years, with many people and without much money.",
    "The foundation published its report on free school meals.",
    "A person of the same name was found in the source of the river.",
    "Our terms and prices may change at any time of the year.",
    "The program of the evening included a later version of the symphony.",
    "The restaurant was fined for selling wine without a license.",
    "The rights of workers are subject to the law of the land.",
]
_FUNCTION_WORDS = frozenset("a an and are as at be by can for from has have he in is it its may no not of on or our she that the they this to under was were which with without you your".split())

NONE, UNKNOWN = "none", "unknown"
CLASSES = (*NOTICES, NONE)
GRAMS = 3
MOST_FEATURES = 4000
#: n-grams of fewer training paragraphs get no weight.
LEAST_PARAGRAPHS = 5
COPIES, STEPS, CALIBRATION_STEPS, L1, SEED = 12, 300, 60, 2e-4, 7
#: Least share of a notice's distinct words that confirms a prediction; least share of the paragraph's own, of LEAST_WORDS at least, that are a notice's.
CONFIRM, CONTAINED, LEAST_WORDS = 0.6, 0.9, 3
#: Distinct anchor words of a line that can belong to a notice.
LEAST_ANCHORS = 2

_SPLIT = "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def grams(words: list[str], anchors: frozenset | None = None) -> list[str]:
    """Distinct n-grams of up to GRAMS words that hold a word of the anchors (any, if None)."""
    out = {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1) if anchors is None or anchors.intersection(words[i : i + n])}
    return sorted(out)


class Model(NamedTuple):
    """Anchor words, n-grams, their weights by class, the classes' constants, and the least shares: of a licence against none, of its family among licences."""

    anchors: list[str]
    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    least_licence: float
    least_family: float


def _variants(text: str, rng: np.random.Generator) -> list[list[str]]:
    """Word lists of the text: whole, then with words dropped, ordinary words around it, or a cut end."""
    base, out = words_of(text), []
    ordinary = [w for s in ORDINARY for w in words_of(s)]
    for k in range(COPIES):
        words = [w for w in base if k < COPIES // 4 or rng.random() > 0.1]
        around = rng.integers(0, 12, 2) if k % 2 else (0, 0)
        pick = lambda n: [ordinary[i] for i in rng.integers(0, len(ordinary), n)]
        out.append(pick(around[0]) + words + pick(around[1]))
    return out


def _fit(examples: list[tuple[list[str], str]], anchors: frozenset, steps: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """n-grams, weights and constants of an L1-regularised softmax regression by accelerated proximal gradient steps."""
    bags = [grams(w, anchors) for w, _ in examples]
    counts: dict[str, int] = {}
    for bag in bags:
        for g in bag:
            counts[g] = counts.get(g, 0) + 1
    names = sorted(sorted((g for g, n in counts.items() if n >= LEAST_PARAGRAPHS), key=lambda g: (-counts[g], g))[:MOST_FEATURES])
    at = {g: k for k, g in enumerate(names)}
    x = np.zeros((len(bags), len(names) + 1), np.float32)
    x[:, -1] = 1
    for row, bag in zip(x, bags, strict=True):
        row[[at[g] for g in bag if g in at]] = 1
    y = np.zeros((len(bags), len(CLASSES)), np.float32)
    y[np.arange(len(bags)), [CLASSES.index(c) for _, c in examples]] = 1
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):  # the largest eigenvalue, by powers
        v = x.T @ (x @ v)
        top = np.linalg.norm(v)
        v /= top
    step = 2 * len(bags) / float(top)
    w = ahead = np.zeros((x.shape[1], len(CLASSES)), np.float32)
    for k in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (p - y)) / len(bags)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * L1, 0)
        ahead, w = new + k / (k + 3) * (new - w), new
    w = w.astype(np.float64)
    return names, w[:-1], w[-1]


def _shares(model: tuple, words: list[str], anchors: frozenset) -> tuple[float, float]:
    """(the licences' share, the largest family's share among them) of a paragraph."""
    names, w, b = model
    at = {g: k for k, g in enumerate(names)}
    z = b + sum((w[at[g]] for g in grams(words, anchors) if g in at), np.zeros(len(b)))
    p = np.exp(z - z.max())
    p /= p.sum()
    licence = 1 - p[CLASSES.index(NONE)]
    return float(licence), float(p[: len(NOTICES)].max() / max(licence, 1e-12))


@lru_cache(maxsize=1)
def train() -> Model:
    """The model of the notices above; the same on every run."""
    return fitted(NOTICES)


def fitted(notices_of: dict[str, list[str]], calibrate: bool = True) -> Model:
    """The model of some notices by family, families as in NOTICES; without calibration the least shares are a half."""
    rng = np.random.default_rng(SEED)
    examples = [(v, family) for family, notices in notices_of.items() for text in notices for v in _variants(text, rng)]
    plain = [(v, NONE) for text in ORDINARY for v in _variants(text, rng)] + [([], NONE)] * COPIES
    anchors = frozenset(w for words, family in examples for text in notices_of[family] for w in words_of(text)) - _FUNCTION_WORDS
    alone = sorted(anchors)
    plain += [([a], NONE) for a in alone for _ in range(4)] + [([alone[i] for i in rng.integers(0, len(alone), 2)], NONE) for _ in range(4 * len(alone))]
    model = _fit(examples + plain, anchors, STEPS)
    known, unseen = [_shares(model, w, anchors) for w, _ in examples], []
    for family in notices_of if calibrate else ():
        left = _fit([e for e in examples[::2] if e[1] != family] + plain[::2], anchors, CALIBRATION_STEPS)
        unseen += [_shares(left, w, anchors) for w, f in examples if f == family]
    none = [_shares(model, w, anchors)[0] for w, _ in plain]
    least_licence = max(0.5, float(np.quantile(none, 0.99))) if calibrate else 0.5
    cuts = np.linspace(0.3, 0.99, 70)
    sure, lost = np.array([f for p, f in known if p >= least_licence]), np.array([f for p, f in unseen if p >= least_licence])
    errors = [(sure < c).mean() * 4 + (lost >= c).mean() if len(lost) else (sure < c).mean() for c in cuts]
    least_family = float(cuts[int(np.argmin(errors))]) if calibrate else 0.5
    names, w, b = model
    keep = np.flatnonzero(np.abs(w).max(axis=1) > 1e-6)
    return Model(sorted(anchors), [names[k] for k in keep], np.round(w[keep], 9), np.round(b, 9), least_licence, least_family)


def classify(paragraphs: DataFrame, model: Model, keys: list[str], text: str) -> DataFrame:
    """(keys, family, score, similarity, contained, confirmed) of the paragraphs that are licences: score is the licences'
    share, family may be unknown; no two paragraphs share their keys, and no key is null; similarity is the largest share of a notice's words that the paragraph holds, contained that of its own words that a notice has."""
    spark = paragraphs.sparkSession
    weights = spark.createDataFrame([(g, *map(float, w)) for g, w in zip(model.features, model.weights, strict=True)], "gram string, " + ", ".join(f"w{k} double" for k in range(len(CLASSES))))
    notices = spark.createDataFrame([(family, sorted(set(words_of(t)))) for family, ts in NOTICES.items() for t in ts], "family string, notice array<string>")
    held = cut(paragraphs.select(*keys, F.col(text).alias("paragraph")))
    words = held.select(*keys, _words("paragraph").alias("words"))

    def sliding(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
        return F.when(F.size("words") >= n, each).otherwise(F.array().cast("array<string>"))

    each = words.select(*keys, F.explode(F.array_distinct(F.concat("words", *map(sliding, range(2, GRAMS + 1))))).alias("gram"))
    z = each.join(F.broadcast(weights), "gram").groupBy(*keys).agg(*[(F.sum(f"w{k}") + float(model.bias[k])).alias(f"z{k}") for k in range(len(CLASSES))])
    top = F.greatest(*[F.col(f"z{k}") for k in range(len(CLASSES))])
    e = [F.exp(F.col(f"z{k}") - top) for k in range(len(CLASSES))]
    licences = sum(e[1 : len(NOTICES)], e[0])
    score: Column = licences / (licences + e[-1])
    best = F.greatest(*[F.struct(F.col(f"z{k}").alias("z"), F.lit(c).alias("c"), e[k].alias("e")) for k, c in enumerate(NOTICES)])
    judged = z.select(*keys, score.alias("score"), best["c"].alias("best"), (best["e"] / licences).alias("share")).filter(F.col("score") >= model.least_licence)
    named = judged.select(*keys, "score", "best", F.when(F.col("share") >= model.least_family, F.col("best")).otherwise(UNKNOWN).alias("family"))
    like = named.join(words.withColumn("words", F.array_distinct("words")), keys).join(F.broadcast(notices.withColumnRenamed("family", "best")), "best")
    both = F.size(F.array_intersect("words", "notice"))
    contained = F.when(F.size("words") >= LEAST_WORDS, both / F.size("words")).otherwise(0.0)
    found = like.groupBy(*keys).agg(F.first("family").alias("family"), F.first("score").alias("score"), F.max(both / F.size("notice")).alias("similarity"), F.max(contained).alias("contained"))
    return found.withColumn("confirmed", (F.col("family") != UNKNOWN) & ((F.col("similarity") >= CONFIRM) | (F.col("contained") >= CONTAINED)))


def _words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def paragraphs(docs: DataFrame, anchors: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, h, p, paragraph): runs of lines that hold enough anchor words, in lower case; a document is its id, as text (empty for null), and a hash of its text, so that repeated rows are one.

    Lines that hold fewer become blank ones within the row, so that blank lines end all runs; a text is split once. A run
    also ends behind a line that ends a sentence, and around a licence tag, so that notices of several licences stay apart.
    """
    known = F.array(*map(F.lit, anchors))
    tag = lambda x: x.rlike("(?i)spdx-license-identifier")
    parted = lambda x: F.concat(F.when(tag(x), "\n").otherwise(""), F.lower(x), F.when(tag(x) | x.rlike(r"[.!?][\"')\]\s]*$"), "\n").otherwise(""))
    line = lambda x: F.when(F.size(F.array_intersect(_words(x), known)) >= LEAST_ANCHORS, parted(x)).otherwise("")
    runs = F.split(F.array_join(F.transform(F.split(text, "\n"), line), "\n"), "\n\n+")
    found = docs.select(_id(key).alias("d"), F.xxhash64(text).alias("h"), F.posexplode(runs).alias("p", "paragraph")).filter(F.trim("paragraph") != "")
    return found.dropDuplicates(["d", "h", "p"])


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_licences (licence paragraphs), n_confirmed, n_unknown, families (sorted, joined by commas; without unknown), score (of the surest paragraph, 0 of none).

    Null and empty texts have no licence; rows with equal id and text each get the same result, null ids as well. Other
    columns of the input are left out. The text stays at the scan: only lines with anchor words are written and shuffled.
    """
    model = train()
    found = classify(paragraphs(docs, model.anchors, key, text), model, ["d", "h", "p"], "paragraph")
    known = F.array_distinct(F.collect_list(F.when(F.col("family") != UNKNOWN, F.col("family"))))
    per_doc = found.groupBy(F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.count("*").alias("n"), F.count_if("confirmed").alias("c"), F.count_if(F.col("family") == UNKNOWN).alias("u"), F.array_join(F.array_sort(known), ",").alias("f"), F.max("score").alias("s"))
    rows = docs.select(F.col(key), _id(key).alias("_mine"), F.xxhash64(text).alias("_own"))
    joined = rows.join(per_doc, (F.col("_mine") == F.col("_d")) & (F.col("_own") == F.col("_h")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return joined.select(F.col(key), zero("n").alias("n_licences"), zero("c").alias("n_confirmed"), zero("u").alias("n_unknown"), F.coalesce("f", F.lit("")).alias("families"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scan(table(spark, sf_dir, "documents"))
